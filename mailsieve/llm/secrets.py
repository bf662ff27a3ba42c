"""Operator 9: secret scan with corpus-wide ownership frequency (DataFrame functions only).

Base spans come from three patterns per text.  A match's place is found without
a UDF: the pieces between the matches (``split``) and the matches themselves
(``regexp_extract_all``) alternate, so running lengths give the code-point
offsets.  Only texts that contain a pattern at all are split.

Ownership: the value of every candidate (the base values and any further token
of MIN_TOKEN or more base64 characters that mixes digits and letters) is
hashed; per hash the distinct repositories (documents) and owners (sources) are
counted.  A value is a widely copied example if ``copied_owners`` owners or more have it, or if its
owners have it in ``copied_repos`` repositories or more each, on average; any other looks live and owner-specific.  Owner-specific tokens
outside the base spans are added as spans of kind ``owned``.

Scale: texts are read once and never shuffled; what is written and shuffled is
one narrow row per document and one per candidate.  Distinct counts are two
combinable aggregates, and the counts are written before the join back, so a
value that a third of all documents share is split by AQE.

Null text is empty; null owner counts as one owner.  Repeated rows are scanned
each for itself and count as one repository.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.session import checkpoint_dir

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 6, 20, 24, 20
#: a run that long is what HEX and its length ask for; shorter runs need no place
HEX_LONG = "[0-9a-f]{%d,}" % MIN_HEX
#: a possible further token, bounded by characters outside the alphabet
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{%d,}={0,2}(?![A-Za-z0-9+/_=-])" % MIN_TOKEN
COPIED_OWNERS = 3
COPIED_REPOS = 10
KINDS = ("assign", "access", "hex", "owned")


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end, match) of every match, in code points."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>").alias("out"))

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        one = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step)["out"]).otherwise(start["out"])


def value_of(kind: Column, match: Column) -> Column:
    """The credential itself: group 2 of an assignment, else the match."""
    return F.when(kind == 0, F.regexp_extract(match, ASSIGN, 2)).otherwise(match)


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of spans per kind; ``owned`` holds the further tokens, not yet judged."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    assign = F.filter(_spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= MIN_VALUE)
    access = F.filter(_spans(text, ACCESS, 1), lambda s: F.length(s["match"]) >= MIN_ACCESS)
    token = F.filter(_spans(text, TOKEN, 3), lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]"))
    return {"assign": F.when(text.rlike(ASSIGN), assign).otherwise(none),
            "access": F.when(text.contains("AKIA"), access).otherwise(none),
            "hex": F.when(text.rlike(HEX_LONG), _spans(text, HEX_LONG, 2)).otherwise(none),
            "owned": F.when(text.rlike(TOKEN), token).otherwise(none)}


def scan(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source",
         copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """One row per document: repository key, ``base`` (spans by start and kind) and ``spans`` (base and owned).

    A span: start, kind (index in KINDS), end, match, and in ``spans`` also n_repos, n_owners, live.
    """
    checkpoint_dir(docs.sparkSession)
    kinds = base_spans(F.col("text"))
    flat = docs.select(F.col(repository).alias("repo"), F.col(owner).alias("owner"), F.col(text).alias("text"))
    flat = flat.select("repo", "owner", *[kinds[k].alias(k) for k in KINDS])
    base = F.array_sort(F.concat("assign", "access", "hex"))
    flat = flat.select(F.monotonically_increasing_id().alias("row"), "repo", "owner", base.alias("base"), "owned").checkpoint()
    apart = F.filter("owned", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    each = flat.select("row", "repo", "owner", F.explode(F.concat("base", apart)).alias("s"))
    each = each.withColumn("h", F.xxhash64(value_of(F.col("s.kind"), F.col("s.match"))))
    repos = each.select("h", "repo").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n_repos"))
    owners = each.select("h", "owner").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n_owners"))
    counted = repos.join(owners, "h").checkpoint()
    owned = (F.col("n_owners") < copied_owners) & (F.col("n_repos") < copied_repos * F.col("n_owners"))
    judged = each.join(counted, "h").withColumn("live", owned)
    kept = judged.where((F.col("s.kind") < 3) | F.col("live"))
    one = F.struct(*[F.col(f"s.{x}").alias(x) for x in ("start", "kind", "end", "match")], "n_repos", "n_owners", "live")
    spans = kept.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    none = F.array().cast(dict(spans.dtypes)["spans"])
    return flat.select("row", F.col("repo").alias(repository), "base").join(spans, "row", "left").select(
        repository, "base", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every base match replaced by ``mark`` (null stays null)."""
    long = F.col(text)
    for pattern in (ASSIGN.replace("]+)", "]{%d,})" % MIN_VALUE), "AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4), HEX_LONG):
        long = F.regexp_replace(long, pattern, mark.replace("$", "\\$"))
    return docs.withColumn(text, long)


def _joined(spans) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"))
