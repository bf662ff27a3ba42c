"""Operator 3: line dedup by pairwise alignment.

Overlapping documents are found through runs: the shortest runs of neighbouring
lines with ``min_words`` words, from every line on and up to it.  A block of so many words that two documents share is
covered by runs that both have.  Every run that two or more documents have is linked to its *owner*, the earliest document with it
(smallest key), so a pair is (owner, later document): linear in the lines, also where a line or a whole text
is in a third of all documents; no pairs within a group are made.  All lines of both documents of a pair are then fetched
and aligned.  So a line goes if and only if it lies in a block of ``min_words`` words that any earlier document has too.

Each pair is aligned by patience diff over its runs (a run is what plain diff calls a line, so whatever is aligned has
``min_words`` words): runs that occur once in both are the
anchors, the longest increasing chain of anchors fixes the order, matches
grow from the chain through neighbouring runs, and the gaps between them are aligned in the same way.  The remainder
(passages in another order) is aligned again until nothing is left to match; further copies of an aligned run count as aligned.
Aligned runs are blocks, and exactly these are deleted from the later document, whatever their lines' frequency
and the table's size; shorter ones (headings, licence lines) stay.

Scale: the lines are hashed where the text is read; what is written is a narrow row of line hashes per document, what is
shuffled that and a row per run.  Owners come from a combinable aggregate and are written, so that
the join back has a shuffle on both sides and AQE can split a hot run or owner.  Only the lines of one pair meet in a row.

Lines are the pieces between newlines; lines without a word are neither linked nor counted: the lines before and after them are neighbours.  Null or empty texts have none and
stay as they are.  Rows of the same key and text are one document (all of them are kept and
changed alike); a null key comes after all others.  Empty tables give empty results.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.session import checkpoint_dir

MIN_WORDS = 10


def increasing_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of (later, owner) positions, given by rising first part, whose second part rises too."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, q) in enumerate(pairs):
        k = bisect.bisect_left(tails, q)
        back[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(q)
            ends.append(i)
        else:
            tails[k], ends[k] = q, i
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(lines: list[dict]) -> list[tuple[int, int]]:
    """Aligned (later, owner) positions of two documents from their shared lines (``at``, ``owner_at``: all positions)."""
    mine = {p: i for i, x in enumerate(lines) for p in x["at"]}
    theirs = {q: i for i, x in enumerate(lines) for q in x["owner_at"]}
    todo = [(sorted(mine), sorted(theirs))]
    out: list[tuple[int, int]] = []
    while todo:
        ps, qs = todo.pop()
        at: dict[int, list[int]] = {}
        owner_at: dict[int, list[int]] = {}
        for place, positions, line in ((at, ps, mine), (owner_at, qs, theirs)):
            for p in positions:
                place.setdefault(line[p], []).append(p)
        both = [(at[i], owner_at[i]) for i in at if i in owner_at]
        anchors = [(p[0], q[0]) for p, q in both if len(p) == len(q) == 1]
        # nothing unique: the first occurrences stand in
        chain = increasing_chain(sorted(anchors or [(p[0], q[0]) for p, q in both]))
        if not chain:
            continue
        matched = dict(chain)
        taken = set(matched.values())
        free, open_ = set(ps), set(qs)
        for step in (1, -1):
            for p, q in (chain if step == 1 else chain[::-1]):
                p, q = p + step, q + step
                while p in free and p not in matched and q in open_ and q not in taken and mine[p] == theirs[q]:
                    matched[p] = q
                    taken.add(q)
                    p, q = p + step, q + step
        found = increasing_chain(sorted(matched.items()))
        out += found
        i = j = 0
        for p, q in [*found, (ps[-1] + 1, qs[-1] + 1)]:  # the gaps between the matches are aligned in the same way
            k, m = bisect.bisect_left(ps, p), bisect.bisect_left(qs, q)
            if k > i and m > j:
                todo.append((ps[i:k], qs[j:m]))
            i, j = k + 1, m + 1
    return sorted(out)


def runs(lines: list[int], words: list[int], min_words: int, step: int):
    """(lines, start, stop) of the shortest runs of neighbours with ``min_words`` words from every position on (1) or up to it (-1).

    Any block of ``min_words`` words is covered by those of both directions inside it.
    """
    for p in range(len(lines)):
        n, k = 0, p
        while n < min_words and 0 <= k < len(lines):
            n += words[lines[k]]
            k += step
        if n >= min_words:
            start, stop = (p, k) if step == 1 else (k + 1, p + 1)
            yield tuple(lines[start:stop]), start, stop


def aligned(items: list[dict]) -> set[int]:
    """Indices of the items that repeated patience alignment of two documents matches.

    ``items`` are what both documents have, with all their places (``at``, ``owner_at``).  What an alignment matches is done
    with all its copies; the remainder is aligned again, with the owner read forwards and backwards (the longer alignment counts, so
    passages in another order end soon), until nothing is left to match.
    """
    left = dict(enumerate(items))
    done: set[int] = set()
    while left:
        names = list(left)
        ways = [patience([{"at": left[i]["at"], "owner_at": sorted(sign * q for q in left[i]["owner_at"])} for i in names]) for sign in (1, -1)]
        at = {p: i for i in names for p in left[i]["at"]}
        matched = {at[p] for p, _ in max(ways, key=len)}
        if not matched:
            break
        done |= matched
        for i in matched:
            del left[i]
    return done


def repeated(mine: list[int], theirs: list[int], words: list[int], min_words: int) -> set[int]:
    """Positions of the later document in blocks that the owner has too; documents are lists of line numbers with their words.

    The sequences aligned are the documents' runs (of both directions), so all that is matched is a common block of ``min_words``
    words, and only that is deleted.
    """
    gone: set[int] = set()
    for step in (1, -1):
        shared: dict[tuple, dict] = {}
        for found, start, stop in runs(mine, words, min_words, step):
            one = shared.setdefault(found, {"at": [], "owner_at": [], "spans": []})
            one["at"].append(start)
            one["spans"].append((start, stop))
        if step == -1:  # a run is known by its last line
            for one in shared.values():
                one["at"] = [stop - 1 for _, stop in one["spans"]]
        for found, start, stop in runs(theirs, words, min_words, step):
            if found in shared:
                shared[found]["owner_at"].append(start if step == 1 else stop - 1)
        items = [x for x in shared.values() if x["owner_at"]]
        for i in aligned(items):
            for start, stop in items[i]["spans"]:
                gone.update(range(start, stop))
    return gone


def _runs(min_words: int):
    """(__run, __key, __hash): the distinct runs of every document, as hashes."""
    def run(batches):
        for batch in batches:
            at, found = [], []
            for i, (lines, words) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                size = dict(zip(lines, words))
                code = {h: k for k, h in enumerate(size)}
                own = {hash(tuple(lines[a:b])) for step in (1, -1) for _, a, b in
                       runs([code[h] for h in lines], list(size.values()), min_words, step)}
                at += [i] * len(own)
                found += own
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column(0).take(at), batch.column(1).take(at)],
                                             ["__run", "__key", "__hash"])

    return run


def _align(min_words: int):
    """(__key, __hash, __gone): positions in the text of the lines that a pair's later document loses."""
    def run(batches):
        for batch in batches:
            gone = []
            for lines, words, place, owner in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                code: dict = {}
                mine = [code.setdefault(h, len(code)) for h in lines]
                size = dict(zip(mine, words))
                # a line that the later document doesn't have is in no common block
                theirs = [code.setdefault(h, len(code)) for h in owner]
                found = repeated(mine, theirs, [size.get(k, 0) for k in range(len(code))], min_words)
                gone.append([place[p] for p in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))],
                                             ["__key", "__hash", "__gone"])

    return run


def repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(__key, __hash of the text, __gone: positions of the lines to delete)."""
    checkpoint_dir(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    worded = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(x.alias("line"), i.alias("at"))),
                      lambda x: x["line"].rlike(r"\S"))
    one = F.struct(F.transform("x", lambda x: F.xxhash64(x["line"])).alias("lines"),
                   F.transform("x", lambda x: F.regexp_count(x["line"], F.lit(r"\S+"))).alias("words"),
                   F.col("x.at").alias("place"))
    lined = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.xxhash64(text).alias("__hash"), worded.alias("x"))
    lined = lined.where(F.size("x") > 0).select("__key", "__hash", one.alias("x")).groupBy("__key", "__hash").agg(
        F.first("x").alias("x")).select("__key", "__hash", "x.lines", "x.words", "x.place").checkpoint()
    each = lined.select("__key", "__hash", "lines", "words").mapInArrow(_runs(min_words), f"__run long, __key {kind}, __hash long")
    order = F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("owner"), F.col("__hash").alias("owner_hash"))
    owners = each.groupBy("__run").agg(F.min(order).alias("first"), F.max(order).alias("last")).where(
        ~F.col("first").eqNullSafe(F.col("last"))).select("__run", "first.owner", "first.owner_hash").checkpoint()
    pairs = each.join(owners, "__run").where(
        ~(F.col("__key").eqNullSafe(F.col("owner")) & (F.col("__hash") == F.col("owner_hash"))))
    pairs = pairs.select("__key", "__hash", "owner", "owner_hash").distinct().checkpoint()
    whole = lined.select(F.col("__key").alias("k"), F.col("__hash").alias("x"), F.col("lines").alias("owner_lines"))
    pairs = pairs.join(whole, F.col("owner").eqNullSafe(F.col("k")) & (F.col("owner_hash") == F.col("x"))).select(
        F.col("__key").alias("later"), F.col("__hash").alias("later_hash"), "owner_lines")
    pairs = pairs.join(lined, F.col("later").eqNullSafe(F.col("__key")) & (F.col("later_hash") == F.col("__hash")))
    gone = pairs.select("__key", "__hash", "lines", "words", "place", "owner_lines").mapInArrow(
        _align(min_words), f"__key {kind}, __hash long, __gone array<int>")
    gone = gone.groupBy("__key", "__hash").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("__gone")))).alias("__gone"))
    return gone.where(F.size("__gone") > 0)


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", drop_emptied: bool = False,
                report: bool = False, **kw) -> DataFrame:
    """``docs`` with the repeated blocks deleted from the later documents.

    ``report`` adds the deleted positions as ``__gone`` (null where nothing is deleted);
    ``drop_emptied`` drops documents of which no word is left.
    """
    gone = repeated_lines(docs, text, key, **kw)
    joined = docs.join(gone, F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(text) == F.col("__hash")), "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    out = joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left))
    if drop_emptied:
        out = out.where(F.col("__gone").isNull() | F.col(text).rlike(r"\S"))
    return out.select(*docs.columns, *["__gone"] * report)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, number of deleted lines, their positions and the text that is left."""
    return docs.select("doc_id", F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_deleted"),
                       F.array_join(F.col("__gone").cast("array<string>"), ",").alias("deleted_lines"), "text")
