"""Many personal data without prefix, spelled out or with other marks, and hardly any base span."""

import random

from swipewatch.llm import pii


def _card(dice):
    digits = [4, *(dice.randint(0, 9) for _ in range(14))]
    odd = sum(d * 2 - 9 * (d > 4) for d in digits[::2]) + sum(digits[1::2])
    text = "".join(map(str, [*digits, -odd % 10]))
    return ".".join(text[i : i + 4] for i in range(0, 16, 4))


def test_wide_spans_are_learned(spark):
    dice, rows, want = random.Random(3), [], {}
    for k in range(1800):
        number = f"({dice.randint(200, 999)}) {dice.randint(200, 999)}-{dice.randint(1000, 9999)}"
        forms = [
            ("phone", "please call ", number),
            ("email", "reports go to ", f"n{dice.randint(0, 10**6)} (at) example (dot) com"),
            ("card", "paid by card ", _card(dice)),
            (None, "order ", str(dice.randint(10**9, 10**10 - 1))),
            (None, "version ", ".".join(str(dice.randint(300, 999)) for _ in range(4))),
            (None, "parts ", ".".join(str(dice.randint(1000, 9999)) for _ in range(2)) + ".77"),
        ]
        kind, before, hit = forms[k % len(forms)]
        rows.append((k, f"{before}{hit} today"))
        want[k] = [(kind, len(before), len(before) + len(hit))] if kind else []
    rows.append((5000, "please call +1 (212) 555-0187 today"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.all_spans(docs).collect()}
    assert len(found.pop(5000)) == 1
    assert found == want
