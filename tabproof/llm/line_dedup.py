"""Fuzzy duplicate lines across documents: MinHash bands, exact checks, one line kept per component."""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabproof.llm.common import (
    BROADCAST_KEYS,
    counted,
    join_by_key,
    measured,
    rows_of,
    saved,
    unused,
    whole_text,
    written,
)
from tabproof.llm.links import linked_components, may_link

#: Code points of a shingle. Unrelated lines of 300 share about 0.05 % of shingles this long.
SHINGLE = 8
BAND_ROWS = 3
#: Probability that two lines at the threshold share no band.
MISSED = 1e-5
#: Places of a line that are hashed in one row, so that coordinates are updated once for all of them.
PLACES = 4
#: Places whose digests one row of a line's set gathers.
GATHERED = 16
#: Code points up to which a line's shingles are held in one array; those of longer lines stay rows.
LONG_LINE = 1_000_000
#: Words of a line's parity map; with 1024 bits few pairs below the threshold are left for the exact check.
LINE_MAP_WORDS = 16
#: Members of a bucket that an aggregate of fixed size tells: the smallest, the largest and what is left of their XOR.
TOLD = 3
#: Times the usual number of tasks for lines that are spread into their shingles.
WIDENED = 4
#: Parts of a line's map that are summed in rows of their own, so that a shingle changes few of its words.
MAP_PARTS = 4
#: Orderings of shingles: three digests, each turned by so many bits.
_TURNS = (0, 21, 42)
_DIGESTS = 3
_WORD = 64
_POINT = 4  # bytes of a code point in UTF-32
_BLANK = (" ", "\t", "\r")


def _normal(line: Column) -> Column:
    """Lower case without outer blanks; the scan for these is spared where none is at an end."""
    lower = F.lower(line)
    outer = [test for blank in _BLANK for test in (F.startswith(line, F.lit(blank)), F.endswith(line, F.lit(blank)))]
    return F.when(reduce(Column.__or__, outer), F.trim(lower, F.lit("".join(_BLANK)))).otherwise(lower)


def _points(line: Column) -> Column:
    """UTF-32 bytes, in which the code points from i on are found without a scan."""
    return F.encode(line, "UTF-32")


def _last_place(points: Column, shingle: int) -> Column:
    """Where the last shingle starts; lines shorter than one have their whole as the only one, at 0."""
    return F.greatest(F.floor(F.octet_length(points) / _POINT) - shingle, F.lit(0)).cast("int")


def _digest(points: Column, at: Column, shingle: int) -> Column:
    return F.xxhash64(F.substring(points, at * _POINT + 1, F.lit(shingle * _POINT)))


def _shingles(lines: DataFrame, shingle: int, *kept: str) -> DataFrame:
    """``lines[kept]`` with ``token``: one row per place of ``points``, the digest of the shingle that starts there."""
    starts = F.sequence(F.lit(0), _last_place(F.col("points"), shingle))
    placed = lines.select(*kept, "points", F.explode(starts).alias("_at"))
    return placed.select(*kept, _digest(F.col("points"), F.col("_at"), shingle).alias("token"))


def _tokens(line: Column, shingle: int) -> Column:
    """Digests of the shingles at all places of a line that fits an array, equal ones too."""

    def at_all_places(points: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), _last_place(points, shingle)), lambda at: _digest(points, at, shingle))

    # The points are an element of an array, so a place reads them where they are instead of copying them.
    return F.get(F.transform(F.array(_points(line)), at_all_places), F.lit(0))


def _shingle_rows(lines: DataFrame, shingle: int, *kept: str) -> DataFrame:
    """``lines[kept]`` with ``tokens``: a row for every ``GATHERED`` places of ``points``, with the digests of their shingles."""
    last = lines.withColumn("_last", _last_place(F.col("points"), shingle))
    starts = F.sequence(F.lit(0), F.col("_last"), F.lit(GATHERED))
    spread = last.select(*kept, "points", "_last", F.explode(starts).alias("_at"))
    places = [F.least(F.col("_at") + j, F.col("_last")) for j in range(GATHERED)]
    return spread.select(*kept, F.array(*[_digest(F.col("points"), at, shingle) for at in places]).alias("tokens"))


def _gathered(tokens: Column) -> Column:
    """Aggregate: the distinct digests in arrays, which is quicker than sorting out a row for each of them."""
    return F.array_distinct(F.flatten(F.collect_list(tokens)))


def _long(line: str) -> Column:
    return F.length(line) > LONG_LINE


def document_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, pos, line, id)``: every line that is not blank, in normal form, with its digest.

    ``version`` tells the texts of one doc_id apart.
    """
    return (
        docs.select("doc_id", whole_text().alias("_t"))
        .select("doc_id", F.xxhash64("_t").alias("version"), F.posexplode(F.split("_t", "\n")).alias("pos", "_l"))
        .where(F.ltrim("_l", F.lit("".join(_BLANK))) != "")
        .select("doc_id", "version", "pos", _normal(F.col("_l")).alias("line"))
        .withColumn("id", F.xxhash64("line"))
    )


def band_count(similarity: float, rows: int = BAND_ROWS, missed: float = MISSED) -> int:
    """Fewest bands of ``rows`` that a pair at ``similarity`` shares none of with probability ``missed`` at most."""
    alike = similarity**rows
    return 1 if alike >= 1 else math.ceil(math.log(missed) / math.log1p(-alike))


def line_signatures(lines: DataFrame, n_bands: int, shingle: int = SHINGLE) -> DataFrame:
    """``(id, m0 … )`` per distinct line: its MinHash coordinates.

    Coordinate i is the smallest digest of all shingles of the line in its own order: one of
    ``_DIGESTS`` digests of the shingle, turned by one of ``_TURNS``, XORed with a mask. The masks of one digest and turn
    differ in their first bits, so they look for their smallest in different parts of the digests. The rows of a band
    come from different digests. Lines are made distinct first, and then spread into rows of ``PLACES`` shingles and
    gathered again in the task that has them.
    """
    rng = random.Random(7)
    orders = _DIGESTS * len(_TURNS)
    n = n_bands * BAND_ROWS
    lead = max(1, (-(-n // orders) - 1).bit_length())  # first bits that tell the masks of one order apart
    masks = [(i // orders << _WORD - lead) | rng.getrandbits(_WORD - lead) for i in range(n)]
    masks = [m - (1 << _WORD) if m >> _WORD - 1 else m for m in masks]
    pointed = lines.select("id", "line").dropDuplicates(["id"]).select("id", _points(F.col("line")).alias("points"))
    last = pointed.withColumn("last", _last_place(F.col("points"), shingle))
    spread = last.select("id", "points", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(PLACES))).alias("at"))
    places = [F.least(F.col("at") + j, F.col("last")) for j in range(PLACES)]
    rows = spread.select("id", *[_digest(F.col("points"), at, shingle).alias(f"d0_{j}") for j, at in enumerate(places)])
    for d in range(1, _DIGESTS):
        rows = rows.select("*", *[F.xxhash64(f"d{d - 1}_{j}").alias(f"d{d}_{j}") for j in range(PLACES)])

    def turned(digest: str, bits: int) -> Column:
        return F.shiftleft(digest, bits).bitwiseOR(F.shiftrightunsigned(digest, _WORD - bits)) if bits else F.col(digest)

    rows = rows.select("id", *[
        turned(f"d{o % _DIGESTS}_{j}", _TURNS[o // _DIGESTS]).alias(f"o{o}_{j}") for o in range(orders) for j in range(PLACES)
    ])
    least = [F.least(*[F.col(f"o{i % orders}_{j}").bitwiseXOR(F.lit(mask)) for j in range(PLACES)]) for i, mask in enumerate(masks)]
    return rows.groupBy("id").agg(*[F.min(place).alias(f"m{i}") for i, place in enumerate(least)])


def line_bands(signatures: DataFrame, n_bands: int) -> DataFrame:
    """``(id, bands)``: a digest for each line and band."""
    bands = [
        F.xxhash64(F.lit(b), *[F.col(f"m{b * BAND_ROWS + r}") for r in range(BAND_ROWS)]) for b in range(n_bands)
    ]
    return signatures.select("id", F.array(*bands).alias("bands"))


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """``(bucket, id, n)``: the distinct rows of ``buckets`` whose bucket has others, with their number ``n``.

    One aggregate of fixed size tells the members of buckets of up to ``TOLD``, which most shared ones are, so no row of a lone
    bucket is looked at again. Larger buckets are joined by their keys, hot ones by broadcast. ``buckets`` is read twice.
    """
    groups = buckets.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor("id").alias("all")
    )
    groups = saved(groups.where("n > 1"))
    third = F.col("all").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    told = F.when(F.col("n") == 2, F.array("lo", "hi")).otherwise(F.array("lo", "hi", third))
    few = groups.where(F.col("n") <= TOLD).select("bucket", F.explode(told).alias("id"), "n")
    large, got = measured(
        groups.where(F.col("n") > TOLD).select("bucket", "n"),
        F.count("*").alias("keys"), F.sum("n").alias("total"), F.max("n").alias("most"),
    )
    if not got["keys"]:
        return few
    if got["keys"] <= BROADCAST_KEYS:
        many = buckets.join(F.broadcast(large), "bucket")
    else:
        many = join_by_key(buckets, (large, got["total"], got["most"]), "bucket")
    return few.unionByName(many.select("bucket", "id", "n"))


def line_maps(tokens: DataFrame) -> DataFrame:
    """``(id, n, p0 …)`` of distinct ``(id, token)``: sizes and parity maps of 64-bit words, first part by part of the map.

    Bit i of a map is whether an odd number of tokens fall on it.
    """
    share = LINE_MAP_WORDS // MAP_PARTS
    bit = F.expr("shiftleft(1L, int(shiftrightunsigned(token, 8) & 63))")
    placed = tokens.select("id", F.pmod("token", F.lit(LINE_MAP_WORDS)).alias("word"), bit.alias("bit"))
    placed = placed.select("id", F.expr(f"word div {share}").alias("part"), F.expr(f"word % {share}").alias("word"), "bit")
    words = [F.expr(f"bit_xor(if(word = {w}, bit, 0L))").alias(f"w{w}") for w in range(share)]
    parts = placed.groupBy("id", "part").agg(F.count("*").alias("n"), *words)
    whole = [F.expr(f"bit_xor(if(part = {w // share}, w{w % share}, 0L))").alias(f"p{w}") for w in range(LINE_MAP_WORDS)]
    return parts.groupBy("id").agg(F.sum("n").alias("n"), *whole)


def line_components(
    lines: DataFrame, *, num: int = 4, den: int = 5, shingle: int = SHINGLE, long_lines: bool = True
) -> DataFrame:
    """``(id, component)`` of the distinct lines linked to another line.

    Lines are linked when their sets of ``shingle``-character shingles have ``den * intersection >= num * union`` and they share
    a band, which pairs at the threshold miss with probability ``MISSED`` at most. ``lines(id, line)`` are all lines;
    ``long_lines`` says whether any is longer than ``LONG_LINE``.
    """
    n_bands = band_count(num / den)
    with written(line_bands(line_signatures(lines, n_bands, shingle), n_bands)) as bands:
        members = saved(shared_buckets(bands.select("id", F.explode("bands").alias("bucket"))))
    ranks = saved(members.groupBy("id").agg(F.sum("n").alias("rank")))
    lines = saved(rows_of(lines.select("id", "line"), "id", ranks).dropDuplicates(["id"]))

    # A line becomes a row for each few of its characters, so its tasks take a fraction of the usual lines.
    tasks = WIDENED * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lines.repartition(tasks, "id")
    pointed = spread.select("id", "line", _points(F.col("line")).alias("points"))
    short = pointed.where(~_long("line")) if long_lines else pointed
    tokens = _shingle_rows(short, shingle, "id").groupBy("id").agg(_gathered(F.col("tokens")).alias("tokens"))
    tokens = tokens.select("id", F.explode("tokens").alias("token"))
    if long_lines:
        tokens = tokens.unionByName(_shingles(pointed.where(_long("line")), shingle, "id").distinct())
    sets = saved(line_maps(tokens))

    def maps(ids: DataFrame) -> DataFrame:
        return rows_of(sets, "id", ids)

    def confirm(pairs: DataFrame) -> DataFrame:
        met = pairs.join(sets.alias("x"), F.col("a") == F.col("x.id")).join(sets.alias("y"), F.col("b") == F.col("y.id"))
        met = met.where(may_link("x", "y", num, den, LINE_MAP_WORDS)).select("a", "b")
        a, b = (lines.select(F.col("id").alias(s), F.col("line").alias(f"line_{s}")) for s in "ab")
        met = met.join(a, "a").join(b, "b").repartition("a", "b")
        long = _long("line_a") | _long("line_b")
        whole = (met.where(~long) if long_lines else met).select(
            "a", "b", *[F.array_distinct(_tokens(F.col(f"line_{s}"), shingle)).alias(f"tokens_{s}") for s in "ab"]
        )
        whole = whole.select("a", "b", (F.size("tokens_a") + F.size("tokens_b")).alias("total"),
                             F.size(F.array_intersect("tokens_a", "tokens_b")).alias("both"))
        whole = whole.select("a", "b", "both", (F.col("total") - F.col("both")).alias("either"))
        if long_lines:
            sides = met.where(long).select("a", "b", F.explode(F.array(
                F.struct(F.lit(1).alias("side"), _points(F.col("line_a")).alias("points")),
                F.struct(F.lit(2).alias("side"), _points(F.col("line_b")).alias("points")),
            )).alias("_s")).select("a", "b", "_s.*")
            held = _shingles(sides, shingle, "a", "b", "side").groupBy("a", "b", "token").agg(F.bit_or("side").alias("held"))
            parts = held.groupBy("a", "b").agg(F.count_if(F.col("held") == 3).alias("both"), F.count("*").alias("either"))
            whole = whole.unionByName(parts)
        return whole.where(F.col("both") * den >= F.col("either") * num).select("a", "b")

    return linked_components(members.select("bucket", "id").join(ranks, "id"), maps, num, den, confirm, LINE_MAP_WORDS)


def duplicate_lines(docs: DataFrame, *, num: int = 4, den: int = 5, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, version, dropped, kept_in)`` of documents that lose lines.

    Lines are compared without case and outer blanks, tabs and carriage returns. Equal lines, and lines linked by
    :func:`line_components`, are one component. It is kept once: at its first place in the
    document of smallest id that holds it. ``dropped`` are the positions (from 0) of the
    other lines, ``kept_in`` the documents that keep theirs.
    """
    with written(document_lines(docs).withColumn("size", F.length("line"))) as lines:
        long_lines = (lines.agg(F.max("size")).first()[0] or 0) > LONG_LINE
        places = saved(lines.select("doc_id", "version", "pos", "id"))
        found = line_components(lines, num=num, den=den, shingle=shingle, long_lines=long_lines)
    repeated = places.groupBy("id").agg(F.min("doc_id").alias("home"), F.count("*").alias("n"))
    known = repeated.join(found.select("id", "component"), "id", "left").where("n > 1 or component is not null")
    known = saved(known.select("id", "home", "n", F.coalesce("component", "id").alias("component")))
    homes = known.groupBy("component").agg(F.min("home").alias("home"))
    known = counted(known.drop("home").join(homes, "component").select("id", "n", "component", "home"))
    met = join_by_key(places, known, "id").select("doc_id", "version", "pos", "component", "home")
    at_home = F.col("doc_id").eqNullSafe(F.col("home"))
    first = met.where(at_home).groupBy("doc_id", "version", "component").agg(F.min("pos").alias("_first"))
    in_home = (
        met.where(at_home)
        .join(first.select(F.col("version").alias("_v"), F.col("component").alias("_c"), F.col("doc_id").alias("_d"), "_first"),
              F.col("version").eqNullSafe(F.col("_v")) & (F.col("component") == F.col("_c")) & F.col("doc_id").eqNullSafe(F.col("_d")))
        .where("pos > _first")
    )
    dropped = met.where(~at_home).select("doc_id", "version", "pos", "home").unionByName(
        in_home.select("doc_id", "version", "pos", "home")
    )
    listed = F.sort_array(F.collect_list(F.struct("pos", "home")))
    return (
        dropped.distinct()
        .groupBy("doc_id", "version")
        .agg(listed.alias("_l"))
        .select("doc_id", "version", F.col("_l.pos").alias("dropped"), F.col("_l.home").alias("kept_in"))
    )


def line_report(docs: DataFrame, *, num: int = 4, den: int = 5, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_lines, n_kept, dropped, kept_in)`` for every row of ``docs(doc_id, text, …)``.

    ``n_lines`` counts all lines, blank ones included; blank lines are structure and always kept.
    A null text counts as empty: one blank line. Repeated rows lose the same lines. A null
    doc_id is never a line's home unless only such rows hold it, and then each keeps its own.
    Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    lost = duplicate_lines(docs, num=num, den=den, shingle=shingle).select(
        F.col("doc_id").alias("_d"), F.col("version").alias("_v"), "dropped", "kept_in"
    )
    sized = docs.select("doc_id", whole_text().alias("_t")).select(
        "doc_id", F.xxhash64("_t").alias("version"), F.size(F.split("_t", "\n")).cast("long").alias("n_lines")
    )
    none = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    return sized.join(lost, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("version") == F.col("_v")), "left").select(
        "doc_id", "n_lines", (F.col("n_lines") - F.coalesce(F.size("dropped"), F.lit(0))).alias("n_kept"),
        F.coalesce("dropped", none[0]).alias("dropped"), F.coalesce("kept_in", none[1]).alias("kept_in"),
    )


def without_duplicate_lines(docs: DataFrame, *, num: int = 4, den: int = 5, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; the other columns stay as they are.

    Documents that lose lines and have nothing but blank ones left are repetitions of others
    and go. Documents that had no line from the start, null texts among them, stay as they are. Repeated rows lose the
    same lines, and a null doc_id is a home like in :func:`line_report`. Other columns come back as they are, whatever their
    names. An empty table stays empty.
    """
    doc, version, dropped = unused(docs.columns, "lost_in", "version", "dropped")
    lost = duplicate_lines(docs, num=num, den=den, shingle=shingle).select(
        F.col("doc_id").alias(doc), F.col("version").alias(version), F.col("dropped").alias(dropped)
    )
    met = docs.join(lost, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(whole_text()) == F.col(version)), "left")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped))
    text = F.array_join(F.transform(kept, lambda at: F.get(lines, at)), "\n")
    text = F.when(F.col(dropped).isNull(), F.col("text")).otherwise(text)
    return (
        met.withColumn("text", text)
        .where(F.col(dropped).isNull() | F.col("text").rlike(r"[^\n \t\r]"))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
