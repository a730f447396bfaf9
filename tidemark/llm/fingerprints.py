"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame operations only.

A text's paragraphs (lines; long ones cut at places that their own words choose) are hashed to digests
that carry a check of themselves. A fingerprint has blocks, so many that each gets about PER_BLOCK
digests, and every block is a sketch: TABLES tables of cells, and each digest of the block is added
to one cell in each table. Two fingerprints subtract cell by cell: what they share cancels, and
peeling recovers the digests that differ. A cell whose value or its negative is a digest (its check
holds, and it belongs in that cell) holds that one alone, which is then taken out of its other cells, and so on.

Sizes are powers of 2, so a larger fingerprint folds into a smaller one by adding cells. Two
fingerprints are first compared folded to the smaller of both sizes. Where that gets stuck in a
block, the subtraction is retried larger, with as many blocks as the larger fingerprint has: each
of its blocks less the digests of the smaller one that belong there, at its own cells, is peeled.
Where that gets stuck too, both sides are sketched again with more cells, subtracted and peeled, and
again with twice the cells until it works. All of it comes from the fingerprints: a block is built
with so many cells that peeling recovers all its digests. Nothing but the two fingerprints is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, text_or_empty

#: Tables of a block, and the fewest cells in each.
TABLES, CELLS = 3, 4
#: Digests of a block on average, and how often its cells may be doubled until it peels.
PER_BLOCK, DOUBLINGS = 4, 10
#: Rounds of peeling: of a difference at first, and of a block on its own.
FIRST_ROUNDS, ROUNDS = 4, 16
#: A difference with a larger share of its cells in use is taken for stuck: it would not peel.
MOST_FULL = 0.75
#: No more blocks than this are folded into one: so many digests would not peel from it, nor fit its cells. Beyond, the larger size comes first.
MOST_FOLDED = 64
#: A digest: a check of 16 bits, and above it 36 bits of hash, of which each table looks at 12.
CHECK_BITS, TABLE_BITS = 16, 12
HASH_BITS = TABLES * TABLE_BITS
#: Lines of more code points are cut where their own characters say: between some sentences, and what is
#: longer still after about one word in CUT_EVERY and after what is no word but a long run without spaces.
LONG_LINE, CUT_EVERY, LONG_WORD = 200, 64, 40
CUT = r"(?<=[.!?] )(?=[A-D])"
WORD_END = r"(?<= )|(?<=[\u3002\uff01\uff1f])|(?<=[0-3])(?=[A-H])"

_CHECK = (1 << CHECK_BITS) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _empty() -> Column:
    return F.array().cast("array<bigint>")


def _count_to(n: Column) -> Column:
    """0 to n - 1, n above 0."""
    return F.sequence(F.lit(0), n - 1)


def _check(hashed: Column) -> Column:
    return F.xxhash64(hashed).bitwiseAND(_long(_CHECK))


def _parts(lines: Column, cut: Callable[[Column], Column]) -> Column:
    """``lines``, the long ones of them cut."""
    return F.flatten(F.transform(lines, lambda x: F.when(F.char_length(x) > LONG_LINE, cut(x)).otherwise(F.array(x))))


def _by_words(line: Column) -> Column:
    """A line cut after words whose hash says so, and after very long ones."""
    ends = lambda w: (F.pmod(F.xxhash64(w), F.lit(CUT_EVERY)) == 0) | (F.char_length(w) > LONG_WORD)
    marked = F.transform(F.split(line, WORD_END), lambda w: F.when(ends(w), F.concat(w, F.lit("\n"))).otherwise(w))
    return F.split(F.array_join(marked, ""), "\n")


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs, blank ones left out."""
    parts = _parts(_parts(F.split(text, "\n"), lambda x: F.split(x, CUT)), _by_words)
    found = F.filter(parts, lambda x: F.btrim(x) != "")
    hashed = F.transform(found, lambda x: F.greatest(_long(1), F.xxhash64(x).bitwiseAND(_long((1 << HASH_BITS) - 1))))
    return F.transform(F.array_distinct(hashed), lambda h: F.shiftleft(h, CHECK_BITS).bitwiseOR(_check(h)))


# One block: an array of cells, table by table.


def _cell_of(digest: Column, at: int, cells: Column) -> Column:
    """The place of a digest's cell in table ``at`` if each table has so many cells: the first bits of the table's own."""
    own = F.shiftright(digest, CHECK_BITS + at * TABLE_BITS).bitwiseAND(_long((1 << TABLE_BITS) - 1))
    return F.shiftright(own * cells, TABLE_BITS).cast("int")


def _placed(found: Column, cells: Column) -> Column:
    """Digests (negative ones too) with the place of their cell in each table."""
    return F.transform(found, lambda x: F.struct(x.alias("x"), *[_cell_of(F.abs(x), t, cells).alias(f"p{t}") for t in range(TABLES)]))


def _tables(cells: Column, body: Callable[[int, Column], Column]) -> Column:
    """All cells, table by table, from table and place."""
    one = lambda t: F.transform(_count_to(cells), lambda i: body(t, i))
    return F.concat(*map(one, range(TABLES)))


def _moved(value: Column, placed: Column, table_: int, place: Column, sign: int) -> Column:
    """A cell's value with the placed digests that belong in it added or taken away."""
    return F.aggregate(placed, value, lambda s, d: F.when(d[f"p{table_}"] == place, s + d["x"] if sign > 0 else s - d["x"]).otherwise(s))


def per_table(cells: Column) -> Column:
    return (F.size(cells) / TABLES).cast("int")


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _pure(cells: Column) -> Column:
    """The digests that are alone in a cell: as they are, or negative if they were taken away. Their other cells hold something too, else
    it is a sum of others that looks like a digest."""
    n = per_table(cells)
    is_digest = lambda v: (F.abs(v) < _long(1 << (HASH_BITS + CHECK_BITS))) & (
        F.abs(v).bitwiseAND(_long(_CHECK)) == _check(F.shiftright(F.abs(v), CHECK_BITS))
    )
    of = lambda v, t: _cell_of(F.abs(v), t, n) + n * t
    place = lambda v, i: F.when(i < n, of(v, 0)).when(i < n * 2, of(v, 1)).otherwise(of(v, 2))
    held = lambda v: (F.get(cells, of(v, 0)) != 0) & (F.get(cells, of(v, 1)) != 0) & (F.get(cells, of(v, 2)) != 0)
    return F.array_distinct(F.filter(cells, lambda v, i: (v != 0) & is_digest(v) & (place(v, i) == i) & held(v)))


def _less(cells: Column, placed: Column, n: Column) -> Column:
    """Cells with placed digests taken away, ``n`` of them in each table."""
    one = lambda t: F.transform(F.slice(cells, n * t + 1, n), lambda v, i: _moved(v, placed, t, i, -1))
    return F.concat(*map(one, range(TABLES)))


def _net(found: Column) -> Column:
    """What is left of digests that were taken out: a sum of digests may look like one and be taken out too; it is then put back, as
    found negative, and so may be what it hid, which is found again. Those that were found both ways cancel; each is left once."""
    times = lambda x: F.size(F.filter(found, lambda y: y == x))
    once = F.size(F.array_distinct(F.transform(found, F.abs))) == F.size(found)
    return F.when(once, found).otherwise(F.filter(F.array_distinct(found), lambda x: times(x) > times(-x)))


def peel(cells: Column, rounds: int = ROUNDS) -> Column:
    """``ok`` and the digests ``found`` of a difference: as they are if the first version has them, negative if the second."""
    state = F.struct(cells.alias("cells"), _empty().alias("found"), F.lit(False).alias("over"))

    def without(now: Column, pure: Column) -> Column:
        n = per_table(now["cells"])
        table_ = lambda d, t: F.transform(F.slice(now["cells"], n * t + 1, n), lambda v, i: F.when(v == 0, v).otherwise(_moved(v, d, t, i, -1)))
        left = let(_placed(pure, n), lambda d: F.concat(*[table_(d, t) for t in range(TABLES)]))
        over = F.struct(now["cells"].alias("cells"), now["found"].alias("found"), F.lit(True).alias("over"))
        peeled = F.struct(left.alias("cells"), F.concat(now["found"], pure).alias("found"), F.lit(False).alias("over"))
        return F.when(F.size(pure) == 0, over).otherwise(peeled)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), state,
        lambda now, _: F.when(now["over"], now).otherwise(let(_pure(now["cells"]), lambda x: without(now, x))),
        lambda now: F.struct((~F.exists(now["cells"], lambda c: c != 0)).alias("ok"), _net(now["found"]).alias("found")),
    )


def sketch(placed: Column, cells: Column) -> Column:
    """A block of placed digests with so many cells in each table."""
    return _tables(cells, lambda t, i: _moved(_long(0), placed, t, i, 1))


def block(found: Column) -> Column:
    """A block of digests with the fewest cells (CELLS in each table, doubled and doubled again) that peeling recovers them all from."""

    def peels(cells: Column, placed: Column, n: Column) -> Column:
        # Where each digest is alone in one of its cells, one round does it.
        alone = lambda d: (F.get(cells, d["p0"]) == d["x"]) | (F.get(cells, n + d["p1"]) == d["x"]) | (F.get(cells, n * 2 + d["p2"]) == d["x"])
        whole = lambda r: r["ok"] & (F.size(r["found"]) == F.size(placed))
        return F.forall(placed, alone) | let(peel(cells), whole)

    def made(n: Column) -> Column:
        done = lambda c, d: F.struct(c.alias("cells"), peels(c, d, n).alias("ok"))
        return let(_placed(found, n), lambda d: let(sketch(d, n), lambda c: done(c, d)))

    start = F.struct(_empty().alias("cells"), F.lit(False).alias("ok"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(DOUBLINGS)), start,
        lambda now, k: F.when(now["ok"], now).otherwise(made(F.call_function("shiftleft", F.lit(CELLS), k))),
        lambda now: F.when(now["ok"], now["cells"]).otherwise(_never_peels("array<bigint>")),
    )


def _never_peels(kind: str) -> Column:
    return F.raise_error(F.lit(f"digests of a block do not peel from {TABLES} tables of {CELLS << DOUBLINGS} cells")).cast(kind)


# Fingerprints: an array of blocks, a power of 2 of them; a digest's block is told by its last bits.


def _grouped(found: Column, n_blocks: Column) -> Column:
    """Digests by block, empty blocks too, in n log n steps: sorted by block behind a mark of each, then cut at the marks."""
    of = lambda x: F.struct(x.bitwiseAND(n_blocks - 1).cast("int").alias("b"), x.alias("x"))
    marks = F.transform(_count_to(n_blocks), lambda b: F.struct(b.cast("int").alias("b"), _long(0).alias("x")))
    ordered = F.sort_array(F.concat(F.transform(found, of), marks))
    written = F.transform(ordered, lambda s: F.when(s["x"] == 0, F.lit("|")).otherwise(F.concat(F.lit(","), s["x"].cast("string"))))
    parts = F.split(F.substring(F.array_join(written, ""), F.lit(2), F.lit(2**31 - 1)), r"\|")
    return F.transform(parts, lambda p: F.transform(F.filter(F.split(p, ","), lambda x: x != ""), lambda x: x.cast("long")))


def _fingerprint(found: Column) -> Column:
    blocks = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2((F.size(found) + 1) / PER_BLOCK)))).cast("int")
    one = lambda x: F.struct(F.size(x).alias("n"), block(x).alias("cells"))
    return F.struct(F.size(found).alias("n"), let(blocks, lambda n: F.transform(_grouped(found, n), one)).alias("blocks"))


def fingerprint(found: Column) -> Column:
    """``n`` digests, and ``blocks`` of their number and cells. It depends on the set of digests alone. ``found`` is computed once."""
    return let(found, _fingerprint)


def _members(blocks: Column, at: Column, n_blocks: Column) -> Column:
    """The blocks that fold into block ``at`` of ``n_blocks``."""
    return F.transform(F.sequence(at, F.size(blocks) - 1, n_blocks), lambda j: F.get(blocks, j))


def _folded(members: Column, cells: Column) -> Column:
    """The sum of blocks, each folded to ``cells`` cells: neighbouring cells of a table are added."""

    def one(cell: Column, i: Column) -> Column:
        step = (F.size(cell) / cells).cast("int")
        return F.aggregate(_count_to(step), _long(0), lambda s, k: s + F.get(cell, i * step + k))

    summed = F.transform(_count_to(cells), lambda i: F.aggregate(members, _long(0), lambda s, m: s + one(m["cells"], i)))
    alone = (F.size(members) == 1) & (F.size(F.get(members, F.lit(0))["cells"]) == cells)
    return F.when(alone, F.get(members, F.lit(0))["cells"]).otherwise(summed)


def _own(member: Column) -> Column:
    """All digests of a block, by peeling it; often the first look finds them: as many as there are, and with the sum of a table's cells."""
    cells, total = member["cells"], lambda x: F.aggregate(x, _long(0), lambda s, v: s + v)
    all_ = lambda p: (F.size(p) == member["n"]) & (total(p) == total(F.slice(cells, F.lit(1), per_table(cells))))
    return let(_pure(cells), lambda p: F.when(all_(p), p).otherwise(peel(cells)["found"]))


def difference_from(a: Column, b: Column, cells: Column) -> Column:
    """How many digests two lists do not share: their sketches subtracted and peeled, at first with so many cells in each table, then with twice as many, ...

    A sketch is a sum, so that of the one's digests and the other's, negated, is the one's less the other's.
    """
    both = F.concat(a, F.transform(b, lambda x: -x))

    def tried(n: Column) -> Column:
        twice = F.least(n * 2, F.lit(CELLS << DOUBLINGS))
        return F.struct(twice.alias("cells"), peel(let(_placed(both, n), lambda d: sketch(d, n))).alias("peeled"))

    start = F.struct(F.lit(False).alias("ok"), _empty().alias("found"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(DOUBLINGS)), F.struct(cells.cast("int").alias("cells"), start.alias("peeled")),
        lambda now, _: F.when(now["peeled"]["ok"], now).otherwise(tried(now["cells"])),
        lambda now: F.when(now["peeled"]["ok"], F.size(now["peeled"]["found"])).otherwise(_never_peels("int")),
    )


# A comparison is four columns, one made of the other: Spark's analyzer gives up on lambdas nested as deep as all of them together.


def _tried(cells: Column) -> Column:
    """How many digests a difference has, from peeling it; -1 if it is stuck, or so full that it is taken for stuck."""
    full = F.size(F.filter(cells, lambda x: x != 0)) > F.size(cells) * MOST_FULL
    return F.when(full, -1).otherwise(let(peel(cells, FIRST_ROUNDS), lambda r: F.when(r["ok"], F.size(r["found"])).otherwise(-1)))


def first_tries(a: Column, b: Column) -> Column:
    """For each block of the smaller fingerprint: its number ``at``, what folds into it of both, ``a`` and ``b``, and how many digests
    ``differ``, from the difference of both sides folded to the fewest cells that a block of theirs has; -1 where it is stuck."""

    def folded(s: Column) -> Column:
        few = F.size(s["a"]) + F.size(s["b"]) <= MOST_FOLDED + 1
        found = let(_fewest(s), lambda n: let(subtract(_folded(s["a"], n), _folded(s["b"], n)), _tried))
        return F.when(s["a"] == s["b"], 0).when(few, found).otherwise(-1)

    one = lambda i, n: let(
        F.struct(_members(a["blocks"], i, n).alias("a"), _members(b["blocks"], i, n).alias("b")),
        lambda s: F.struct(i.alias("at"), s["a"].alias("a"), s["b"].alias("b"), folded(s).alias("differ")),
    )
    return let(F.least(F.size(a["blocks"]), F.size(b["blocks"])), lambda n: F.transform(_count_to(n), lambda i: one(i, n)))


def _fewest(tried: Column) -> Column:
    return F.array_min(F.transform(F.concat(tried["a"], tried["b"]), lambda m: F.size(m["cells"])))


def recovered(tries: Column) -> Column:
    """Tries as ``differ`` and, where one was stuck, ``pairs`` to be subtracted one by one: ``few``, digests, and a block ``many``; ``cells`` were tried.

    One side has a single block; its digests are dealt over as many blocks as the other has.
    Where both have a single one, ``cells`` says how many of them in each table were tried in vain, else 0.
    """

    def pairs(t: Column, n_blocks: Column) -> Column:
        a_few = F.size(t["a"]) <= F.size(t["b"])
        single, many = F.get(F.when(a_few, t["a"]).otherwise(t["b"]), F.lit(0)), F.when(a_few, t["b"]).otherwise(t["a"])
        tried = F.when(F.size(many) == 1, (_fewest(t) / TABLES).cast("int")).otherwise(0)
        once = F.struct(_own(single).alias("few"), many.alias("many"), tried.alias("tried"), (n_blocks * F.size(many) - 1).alias("mask"))
        own = lambda s, at: F.filter(s["few"], lambda x: x.bitwiseAND(s["mask"]) == at)
        pair = lambda s, m, j: F.struct(own(s, t["at"] + j * n_blocks).alias("few"), m.alias("many"), s["tried"].alias("cells"))
        return let(once, lambda s: F.transform(s["many"], lambda m, j: pair(s, m, j)))

    done = lambda t: F.struct(t["differ"].alias("differ"), F.array().cast(_PAIRS).alias("pairs"))
    stuck = lambda t: F.struct(t["differ"].alias("differ"), pairs(t, F.size(tries)).alias("pairs"))
    return F.transform(tries, lambda t: F.when(t["differ"] >= 0, done(t)).otherwise(stuck(t)))


_PAIRS = "array<struct<few: array<bigint>, many: struct<n: int, cells: array<bigint>>, cells: int>>"


def second_tries(tries: Column) -> Column:
    """Tries whose pairs are subtracted at the size of the block: its cells less the few digests. Where that is stuck too, ``differ`` of the
    pair is -1, ``many`` are the block's digests, and ``cells`` says how many to go on with, no fewer than 2 for each digest."""

    def differ(p: Column) -> Column:
        own = per_table(p["many"]["cells"])
        less = let(own, lambda n: let(_placed(p["few"], n), lambda d: _less(p["many"]["cells"], d, n)))
        # A block less nothing is the block, which was made so that all its digests peel.
        return F.when(F.size(p["few"]) == 0, p["many"]["n"]).when(own <= p["cells"], -1).otherwise(let(less, _tried))

    def pair(p: Column, d: Column) -> Column:
        # Two empty sides are taken for one digest: the logarithm of 0 is null, which least passes over.
        wanted = F.least(F.ceil(F.log2(F.greatest(F.lit(1), F.size(p["few"]) + p["many"]["n"]) * (2.0 / TABLES))), F.lit(TABLE_BITS))
        cells = F.greatest(per_table(p["many"]["cells"]) * 2, F.pow(F.lit(2), wanted).cast("int"))
        more = F.struct(d.alias("differ"), p["few"].alias("few"), _own(p["many"]).alias("many"), F.least(cells, F.lit(CELLS << DOUBLINGS)).alias("cells"))
        none = F.struct(d.alias("differ"), _empty().alias("few"), _empty().alias("many"), F.lit(0).alias("cells"))
        return F.when(d >= 0, none).otherwise(more)

    again = lambda t: F.transform(t["pairs"], lambda p: let(differ(p), lambda d: pair(p, d)))
    return F.transform(tries, lambda t: F.struct(t["differ"].alias("differ"), again(t).alias("pairs")))


def retried(tries: Column) -> Column:
    """How many digests differ, in blocks that came out at first, in pairs that came out then, and in those that are subtracted again."""
    one = lambda p: F.when(p["differ"] >= 0, p["differ"]).otherwise(difference_from(p["few"], p["many"], p["cells"]))
    again = lambda t: F.aggregate(F.transform(t["pairs"], one), F.lit(0), lambda s, x: s + x)
    counts = F.transform(tries, lambda t: F.when(t["differ"] >= 0, t["differ"]).otherwise(again(t)))
    return F.aggregate(counts, F.lit(0), lambda s, x: s + x)


def with_difference(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """A column more: how many digests two columns of fingerprints do not share."""
    tries = df.withColumn(name, first_tries(F.col(a), F.col(b)))
    return tries.withColumn(name, recovered(F.col(name))).withColumn(name, second_tries(F.col(name))).withColumn(name, retried(F.col(name)))


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """A column more: the share of common digests among all digests of two columns of fingerprints, from the number that differ; 1 for two empty ones."""
    both, d = F.col(a)["n"] + F.col(b)["n"], F.col(name)
    return with_difference(df, a, b, name).withColumn(name, F.when(both == 0, 1.0).otherwise((both - d) / (both + d)))


def written(mark: Column) -> Column:
    """A fingerprint as a string: the number of digests, then each block's own number and its cells in hexadecimal."""
    cells = lambda b: F.array_join(F.transform(b["cells"], lambda c: F.when(c == 0, "").otherwise(F.lower(F.hex(c)))), ".")
    blocks = F.transform(mark["blocks"], lambda b: F.concat(b["n"].cast("string"), F.lit("/"), cells(b)))
    return F.concat(mark["n"].cast("string"), F.lit(":"), F.array_join(blocks, ";"))


def read(text: Column) -> Column:
    """A fingerprint from what ``written`` makes of it."""
    cell = lambda c: F.when(c == "", _long(0)).otherwise(F.conv(c, 16, 10).cast("long"))
    one = lambda b: F.struct(
        F.substring_index(b, "/", 1).cast("int").alias("n"), F.transform(F.split(F.substring_index(b, "/", -1), r"\."), cell).alias("cells")
    )
    blocks = F.transform(F.split(F.substring_index(text, ":", -1), ";"), one)
    return F.struct(F.substring_index(text, ":", 1).cast("int").alias("n"), blocks.alias("blocks"))


_NO_ID = -(1 << 63)
_FINE = 64
_AT_ONCE = 1024


def _below(doc_id: Column, cuts: list[int], how: Callable[[Column, Column], Column]) -> Column:
    """How many cuts lie below an id (as ``how`` compares them), found among every _FINE-th cut, then among those between."""
    count = lambda xs: F.size(F.filter(xs, lambda c: how(c, doc_id)))
    if not cuts:
        return F.lit(0)
    rows = [cuts[i : i + _FINE] for i in range(0, len(cuts), _FINE)]
    coarse = F.array(*[F.lit(r[-1]) for r in rows])
    fine = F.array(*[F.array(*map(F.lit, r)) for r in rows])
    at = count(coarse)
    return at * _FINE + F.coalesce(count(F.get(fine, at)), F.lit(0))


def _bucket(doc_id: Column, hashed: Column, cuts: list[int]) -> Column:
    """The range of a row. An id that many rows share is several cuts at once; its rows are spread by hash over the ranges between."""
    low, high = _below(doc_id, cuts, lambda c, x: c < x), _below(doc_id, cuts, lambda c, x: c <= x)
    part = hashed.cast("double") / F.lit(2.0**64) + 0.5
    return low + F.least(high - low, F.floor(part * (high - low + 1)).cast("int"))


def _counted_once(plain: DataFrame, cuts: list[int], least: float) -> DataFrame:
    """``plain`` with ``copies``: rows equal in id and text, where there are more than ``least`` of them, become one.

    Only an id that is several cuts at once can have so many rows. Fewer than rows / ``least`` keys are
    looked up. Copies are summed before they are shuffled.
    """
    ids = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    if not ids:
        return plain.withColumn("copies", F.lit(1).cast("long"))
    keys = plain.where(F.col("_id").isin(ids)).groupBy("_id", "_h").count().where(F.col("count") > least).select("_id", "_h")
    marked = plain.join(F.broadcast(keys.withColumn("_heavy", F.lit(True))), ["_id", "_h"], "left")
    once = marked.where("_heavy").groupBy("_id", "_h", "text").agg(F.count(F.lit(1)).alias("copies"))
    return marked.where("_heavy is null").select("_id", "text", "_h", F.lit(1).cast("long").alias("copies")).unionByName(once)


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as ``copies`` says, at most _AT_ONCE times in a row, so that many copies are spread over tasks."""
    spots = F.explode(F.sequence(_long(0), F.floor((F.col("copies") - 1) / _AT_ONCE)))
    # A stated number, as adaptive execution would join partitions by their size before the copies are made.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.withColumn("_spot", spots).repartition(n, "doc_id", "_spot")
    times = F.least(F.lit(_AT_ONCE), F.col("copies") - F.col("_spot") * _AT_ONCE)
    return spread.withColumn("_time", F.explode(F.sequence(_long(1), times))).drop("_time", "_spot", "copies")


def with_next(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``doc_id, text, mark`` with ``next_text, next_mark`` of the next row in descending doc_id; mark: the fingerprint.

    After the last row comes the first. Ids are cut into ranges at their quantiles; each range is
    ordered on its own, with a copy of the row that follows it at its end. Texts are shuffled once.
    Very many rows of one id and text are ordered as one and follow each other; ``copies`` says how
    many such rows a row stands for. Whether it is ever more than 1 is returned with the rows.
    """
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"), text_or_empty().alias("text"))
    plain = plain.withColumn("_h", F.xxhash64("text"))
    n_ranges = max(8, min(8192, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    points = [(i + 1) / n_ranges for i in range(n_ranges - 1)]
    found, n_rows = plain.agg(F.percentile_approx("_id", points, 10 * n_ranges), F.count(F.lit(1))).first()
    cuts = sorted(found or [])
    many = len(set(cuts)) < len(cuts)
    plain = _counted_once(plain, cuts, n_rows / n_ranges)
    bucketed = plain.withColumn("b", _bucket(F.col("_id"), F.col("_h"), cuts))
    # The first row of each range, n_ranges at most.
    heads = bucketed.groupBy("b").agg(F.max(F.struct("_id", "_h")).alias("m")).collect()
    order = sorted(((r["b"], r["m"]["_id"], r["m"]["_h"]) for r in heads), reverse=True)
    placed = bucketed.withColumn("mark", fingerprint(digests(F.col("text"))))
    own = F.struct(F.col("b").alias("b"), F.lit(0).alias("ghost"))
    if order:
        known = lambda k: F.create_map(*[F.lit(x) for row in order for x in (row[0], row[k])])[F.col("b")]
        after = F.create_map(*[F.lit(x) for k, row in enumerate(order) for x in (row[0], order[k - 1][0])])[F.col("b")]
        ghost = F.struct(after.alias("b"), F.lit(1).alias("ghost"))
        is_head = (F.col("_id") == known(1)) & (F.col("_h") == known(2))
        spots = F.when(is_head, F.array(own, ghost)).otherwise(F.array(own))
    else:
        spots = F.array(own)
    placed = placed.withColumn("_spot", F.explode(spots)).select("_id", "_h", "text", "mark", "copies", "_spot.*")
    down = Window.partitionBy("b").orderBy("ghost", F.desc("_id"), F.desc("_h"))
    rows = (
        placed.withColumn("next_text", F.lead("text").over(down))
        .withColumn("next_mark", F.lead("mark").over(down))
        .where("ghost = 0")
        .select(F.when(F.col("_id") != _NO_ID, F.col("_id")).alias("doc_id"), "text", "mark", "next_text", "next_mark", "copies")
    )
    if many:
        last = F.struct("next_text", "next_mark", _long(1).alias("copies"))
        others = F.struct(F.col("text").alias("next_text"), F.col("mark").alias("next_mark"), (F.col("copies") - 1).alias("copies"))
        rows = rows.select("doc_id", "text", "mark", F.explode(F.when(F.col("copies") > 1, F.array(last, others)).otherwise(F.array(last))).alias("_n"))
        rows = rows.select("doc_id", "text", "mark", "_n.*")
    return rows, many


def edited_text(text: Column, other: Column) -> Column:
    """The last third of a text, in code points rounded down, replaced by as many of another's first (or all)."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(other, F.lit(1), third))


def fingerprints(docs: DataFrame) -> DataFrame:
    """A document's fingerprint, that of its edited text, and their likeness.

    * A null text is as an empty one: no paragraph, all cells zero. Two such texts are alike (1.0).
    * A fingerprint depends on the set of a text's paragraphs alone: equal texts have equal ones.
    * A text of n paragraphs, whatever their number, takes about n log n steps; fingerprints grow with n.
    * Rows that share a doc_id follow each other by a hash of their text, downwards. A null doc_id comes
      last and stays null. A single row is followed by itself. An empty table gives an empty result.
    * Rows equal in doc_id and text follow each other; many of them are worked out once and repeated over many tasks.
    * Only doc_id and text are read.
    """
    rows, many = with_next(docs)
    paired = (
        rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
        .withColumn("edited_mark", fingerprint(digests(F.col("edited"))))
        .select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "mark", "edited_mark", "next_mark", "copies")
    )
    compared = with_likeness(with_likeness(paired, "mark", "edited_mark", "near_edited"), "mark", "next_mark", "near_next")
    made = compared.select(
        "copies", "doc_id", "n_chars", "edited_sha256",
        written(F.col("mark")).alias("fingerprint"), written(F.col("edited_mark")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
    return _repeated(made) if many else made.drop("copies")


def op3_paragraph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
