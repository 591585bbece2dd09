"""Personal data by candidate gradient boosting, in DataFrame functions alone.

1. Generators of high recall propose spans, overlapping ones too: for each kind a strict pattern
   (the base) and a wide one (spelled-out or split addresses, numbers without prefix, other marks).
2. Each candidate is described by its format (digits, groups, marks, checksums) and its context (the
   characters and telling words around it).
3. Boosted trees learn which candidates are personal data. Base candidates teach by the rules that
   must hold for them; wide ones are right where they overlap a base span of their kind that holds, or
   where the rules of their kind say so after undoing (at), (dot), marks and 00 (``_evidence``); wrong
   where these rules break; without evidence either way they teach nothing. The fit uses at most
   ``fit_rows`` candidates, those with the smallest hashes; scoring uses all.
4. On other wide candidates (another third of the hashes) a threshold per kind is calibrated: the lowest
   score above which the share of right ones is at least ``precision``. Wide candidates above it that
   touch no base span are added; of overlapping ones the one that begins first stays. Base spans that
   hold always stay.

Texts are read once; what is stored of them is the matches, their distances and a few characters on
either side. Null and empty texts have no spans. Repeated rows and ids are separate rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swipewatch.llm.shared import stored, whole_text

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
# What a base span of each kind looks like. Possessive, and begun only where a run
# begins, so that long runs cost linear time; the matches are those of the plain patterns.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?+(?:@|\(at\)|\[at\])\x20?+[A-Za-z0-9-]++(?:\x20?+(?:\.|\(dot\)|\[dot\])\x20?+[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?+\[?+\.\]?+\x20?+[0-9]{1,3}+){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{3,6}+(?:[\x20._/-]{1,2}+[0-9]{2,6}+){2,5}(?![0-9])",
    "phone": r"(?<![0-9])(?:00[0-9]{1,3}[\x20.-]?+)?+(?:\([0-9]{2,4}\)|[0-9]{3})[\x20.-]{0,2}+[0-9]{3,4}[\x20.-]?+[0-9]{3,4}(?![0-9])",
}
GENERATORS = [(k, True, BASE[k]) for k in KINDS] + [(k, False, WIDE[k]) for k in KINDS]
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
# Words before a span, or before its international prefix, that tell what it is.
TELLING = (
    r"(?i)(?:mail|write|contact|call|phone|tel|fax|mobile|card|visa|account|pay|ip|host|server|addr)[^\s]{0,8}"
    r"\s{0,3}(?:\+[0-9]{1,3}[\s.-]?)?$"
)
# The same for each kind by itself, with a few small words in between.
_WORDS = {
    "email": "e-?mail|mail|write|contact|reach",
    "ip": "ip|host|server|addr|address",
    "card": "card|visa|mastercard|amex|account|pay|paid",
    "phone": "call|phone|tel|telephone|fax|mobile|cell|contact|dial|reach",
}
TELLING_KIND = {
    k: rf"(?i)\b(?:{w})s?\b[.:=#]?(?:\s+(?:me|us|at|on|to|is|no|nr|number|under)\b[.:]?){{0,3}}\s{{0,3}}(?:\+[0-9]{{1,3}}[\s.-]?)?$"
    for k, w in _WORDS.items()
}
AROUND = 24  # characters of context on either side


@dataclass(frozen=True)
class PiiPolicy:
    fit_rows: int = 20_000
    precision: float = 0.98
    rounds: int = 12
    depth: int = 3
    leaf_rows: int = 10  # candidates in a leaf at least: single odd ones teach nothing


def _matches(text: Column, number: int) -> Column:
    """Array of (gen, place, gap, hit, before, after) of one generator's matches, in order.

    ``gap`` is the number of characters between the match and the one before it.
    """
    kind, _, pattern = GENERATORS[number]
    mark = F.regexp_like(text, F.lit(r"@|[(\[]at[)\]]" if kind == "email" else "[0-9]"))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    each = F.transform(
        F.arrays_zip(hits.alias("hit"), between.alias("gap"), F.slice(between, 2, F.size(between)).alias("next")),
        lambda m, i: F.struct(
            F.lit(number).alias("gen"),
            i.alias("place"),
            F.length(m["gap"]).alias("gap"),
            m["hit"].alias("hit"),
            F.right(m["gap"], F.lit(AROUND)).alias("before"),
            F.left(m["next"], F.lit(AROUND)).alias("after"),
        ),
    )
    found = F.filter(each, lambda m: m["hit"].isNotNull())
    return F.when(mark, F.when(F.regexp_like(text, F.lit(pattern)), found))


def scan(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, matches) of every row, stored; ``row`` tells rows apart from here on."""
    narrow = docs.select(F.col(id_).alias("id"), whole_text(text).alias("text"))
    none = F.array().cast("array<struct<gen:int,place:int,gap:int,hit:string,before:string,after:string>>")
    lists = [F.coalesce(_matches(F.col("text"), g), none) for g in range(len(GENERATORS))]
    return stored(narrow.select(F.monotonically_increasing_id().alias("row"), "id", F.concat(*lists).alias("matches")), "matches")


def _picked(values: dict, default) -> Column:
    out = F.lit(default)
    for kind, value in values.items():
        out = F.when(F.col("kind") == kind, value).otherwise(out)
    return out


def _told() -> Column:
    """Whether a word of the candidate's own kind stands before it."""
    return _picked({k: F.regexp_like("before", F.lit(r)) for k, r in TELLING_KIND.items()}, False)


def _evidence() -> Column:
    """Label of a wide candidate by the rules of its kind alone: 1, 0, or null without evidence."""
    told, h, digits = _told(), F.col("hit"), F.col("digits")
    solid = F.regexp_like("before", F.lit(r"[A-Za-z0-9._/=+-]$")) | F.regexp_like("after", F.lit(r"^[A-Za-z0-9_/=-]"))
    undone = F.regexp_replace(F.regexp_replace(h, r" ?[(\[]at[)\]] ?| ?@ ?", "@"), r" ?[(\[]dot[)\]] ?", ".")
    mail = F.regexp_like(undone, F.lit(rf"^[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}$"))
    spelled = F.regexp_like(h, F.lit(r"[(\[](?:at|dot)[)\]]"))
    address = F.regexp_replace(h, r"[ \[\]]", "")
    octets = F.regexp_like(address, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    card = F.length(digits).between(14, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    grouped = F.regexp_like(h, F.lit(r"^[0-9]{4}(?:([^0-9]{1,2})[0-9]{4})(?:\1[0-9]{4}){2}$|^[0-9]{4}([^0-9]{1,2})[0-9]{6}\2[0-9]{5}$"))
    marked = F.regexp_like(h, F.lit("[^0-9]"))
    bare = F.regexp_replace(digits, "^00", "")
    phone = F.length(bare).between(10, 15)
    right = {
        "email": mail & (spelled | told),
        "ip": octets & (told | F.contains(h, F.lit("["))),
        "card": card & (told | grouped),
        "phone": phone & marked & told & ~solid,
    }
    wrong = {"email": ~F.regexp_like(undone, F.lit("[A-Za-z]{2,}$")), "ip": ~octets, "card": ~card, "phone": ~phone | solid | ~marked & ~told}
    return F.when(_picked(right, False), 1.0).when(_picked(wrong, False), 0.0)


def candidates(found: DataFrame) -> DataFrame:
    """One row per candidate: place in its text, whether it is a base span that holds, label and features."""
    flat = found.select("row", F.explode("matches").alias("m")).select("row", "m.*")
    size = F.length("hit")
    upto = F.sum(F.col("gap") + size).over(Window.partitionBy("row", "gen").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    digits = F.regexp_replace("hit", "[^0-9]", "")
    spans = flat.select(
        "row",
        F.element_at(F.array(*[F.lit(k) for k, _, _ in GENERATORS]), F.col("gen") + 1).alias("kind"),
        (F.col("gen") < len(KINDS)).alias("strict"),
        (upto - size).alias("start"),
        upto.alias("end"),
        "hit",
        "before",
        "after",
        digits.alias("digits"),
    )
    n = F.length("digits")
    rules = {
        "email": F.lit(True),
        "ip": F.regexp_like("hit", F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        "card": n.between(14, 19) & F.coalesce(F.call_function("luhn_check", F.col("digits")), F.lit(False)),
        "phone": n.between(10, 15),
    }
    spans = spans.withColumn("base", F.col("strict") & _picked(rules, False))
    spans = spans.withColumn("over_base", _touches_base("row", "kind"))
    label = F.when(F.col("strict"), F.col("base").cast("double")).when(F.col("over_base"), 1.0).otherwise(_evidence())
    h = F.col("hit")
    features = {
        "kind_no": _picked({k: F.lit(float(i)) for i, k in enumerate(KINDS)}, 0.0),
        "n_chars": F.length(h),
        "n_digits": n,
        "n_groups": F.regexp_count(h, F.lit("[0-9]+")),
        "n_marks": F.regexp_count(h, F.lit("[^A-Za-z0-9]")),
        "n_spaces": F.regexp_count(h, F.lit(" ")),
        "longest_group": F.array_max(F.transform(F.split(h, "[^0-9]+"), lambda x: F.length(x))),
        "different_digits": F.size(F.array_distinct(F.split("digits", ""))),
        "brackets": F.regexp_like(h, F.lit(r"[(\[]")),
        "at": F.contains(h, F.lit("@")),
        "luhn": F.coalesce(F.call_function("luhn_check", F.col("digits")), F.lit(False)),
        "octets": F.regexp_like(h, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        "last_label": F.length(F.regexp_extract(h, r"([A-Za-z]+)$", 1)),
        "solid_before": F.regexp_like("before", F.lit(r"[A-Za-z0-9._/=-]$")),
        "solid_after": F.regexp_like("after", F.lit(r"^[A-Za-z0-9_/=-]")),
        "told": F.regexp_like("before", F.lit(TELLING)),
        "told_kind": _told(),
        "quoted": F.regexp_like("before", F.lit(r"[\"'=:]\s?$")),
    }
    return spans.select(
        "row", "kind", "strict", "base", "start", "end", label.alias("label"),
        F.xxhash64("hit", "before", "after", "kind").alias("dice"),
        *[c.cast("double").alias(name) for name, c in features.items()],
    )


FEATURES = (
    "kind_no n_chars n_digits n_groups n_marks n_spaces longest_group different_digits brackets at luhn octets"
    " last_label solid_before solid_after told told_kind quoted"
).split()


def _touches_base(*keys) -> Column:
    """Whether a base span that holds overlaps the row's span, among rows with the same ``keys``.

    Spans that begin earlier are seen in one direction, later ones in the other; both are running
    values, so a text with very many spans costs in proportion to them.
    """
    order = [F.col("start"), F.col("end"), F.col("base")]
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(earlier)
    first = F.min(F.when(F.col("base"), F.col("start"))).over(later)
    return F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(first < F.col("end"), F.lit(False))


def fitted(spans: DataFrame, p: PiiPolicy):
    """(scoring function for candidates, threshold per kind); None where there is nothing to tell apart."""
    teach = spans.where("label IS NOT NULL").where(F.pmod("dice", F.lit(3)) != 0).orderBy("dice", "start", "row").limit(p.fit_rows)
    teach = stored(teach, "teach").coalesce(4)
    if teach.select("label").distinct().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(
        labelCol="label", maxIter=p.rounds, maxDepth=p.depth, stepSize=0.3, seed=7,
        minInstancesPerNode=p.leaf_rows, checkpointInterval=-1, maxBins=32,
    ).fit(assembler.transform(teach))

    def score(df: DataFrame) -> DataFrame:
        made = trees.transform(assembler.transform(df))
        return made.withColumn("score", vector_to_array("probability")[1])

    bins = (
        score(spans.where("NOT strict AND label IS NOT NULL").where(F.pmod("dice", F.lit(3)) == 0))
        .groupBy("kind", F.floor(F.col("score") * 100).cast("int").alias("bin"))
        .agg(F.sum("label").alias("right"), F.count("*").alias("n"))
        .collect()  # at most 4 x 101 rows
    )
    limits = {}
    for kind in KINDS:
        right = n = 0.0
        for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
            right, n = right + r["right"], n + r["n"]
            if (right + 1) / (n + 2) >= p.precision:
                limits[kind] = r["bin"] / 100
    return score, limits


def all_spans(docs: DataFrame, id_: str = "doc_id", text: str = "text", p: PiiPolicy = PiiPolicy()) -> DataFrame:
    """One row per row of ``docs``: id and ``spans``, an array of (start, end, kind, base) in order.

    Places count characters (code points); ``end`` is exclusive.
    """
    found = scan(docs, id_, text)
    spans = stored(candidates(found), "spans")
    base = spans.where("base").select("row", "kind", "start", "end", "base")
    model = fitted(spans, p)
    kept = base
    if model is not None and model[1]:
        score, limits = model
        wide = score(spans.where("NOT strict"))
        wide = wide.where(F.col("score") >= _picked({k: F.lit(v) for k, v in limits.items()}, 2.0))
        both = base.union(wide.select("row", "kind", "start", "end", "base"))
        by_start = Window.partitionBy("row").orderBy("start", "end", "kind")
        free = both.withColumn("touches", _touches_base("row")).where("base OR NOT touches")
        reach = F.max(F.when(~F.col("base"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
        kept = free.withColumn("reach", reach).where("base OR reach IS NULL OR reach <= start").drop("touches", "reach")
    order = F.struct(
        F.col("start").cast("long").alias("start"),
        _picked({k: F.lit(i) for i, k in enumerate(KINDS)}, 9).alias("no"),
        F.col("end").cast("long").alias("end"),
        "kind",
        "base",
    )
    lists = kept.groupBy("row").agg(F.array_sort(F.collect_list(order)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string,base:boolean>>")
    return (
        found.select("row", "id")
        .join(lists, "row", "left")
        .select(F.col("id").alias(id_), F.coalesce("spans", none).alias("spans"))
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    start = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("upto"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["upto"], a).otherwise(
            F.struct(
                s["end"].alias("upto"),
                F.concat(
                    a["out"],
                    F.substring(text, (a["upto"] + 1).cast("int"), (s["start"] - a["upto"]).cast("int")),
                    F.lit("["),
                    s["kind"],
                    F.lit("]"),
                ).alias("out"),
            )
        ),
    )
    return F.concat(start["out"], F.substring(text, (start["upto"] + 1).cast("int"), F.length(text)))
