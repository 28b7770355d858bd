"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests: subtract two, peel out what differs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealgrid.llm.common import land

#: A sketch has three tables of this many cells; each paragraph lies in one cell of each.
CELLS = 4
#: Paragraphs of both versions that a part of a larger sketch holds on average.
PART_LOAD = 8
#: Times the cells of a part double before its digests are compared directly.
RETRIES = 8
#: Every line break, and every sentence end in any script and case, marks and closing brackets or quotes after it included, ends a part.
CLOSERS = r"[\p{Pe}\p{Pf}\p{Pi}\"'*]"
SENTENCES = rf"([.!?]{CLOSERS}{{0,3}})[\s\p{{Z}}]+|[\n\r\x0B\x0C]+"
#: The rarer marks: with a space after them, without, and line breaks. Texts without any of them aren't searched for them.
SPACED, UNSPACED, BREAKS = "\u2026\u037e\u0589\u061f\u06d4\u0964\u0965\u1362\u104b\u17d4", "\u3002\uff0e\uff01\uff1f\uff61", "\u0085\u2028\u2029"
RARE_SENTENCES = rf"([{SPACED}]{CLOSERS}{{0,3}})[\s\p{{Z}}]+|([{UNSPACED}])(?![\p{{Pe}}\p{{Pf}}\p{{Po}}])|[{BREAKS}]+"
#: Stands at the end of each part before the text is split; where a text holds it, it ends a part too.
END = "\u0001"
#: A sentence of more words than this is cut at the words whose hash says so, one in RUN on average, and where RUNS * RUN words hold none.
LONG_SENTENCE, RUN, RUNS = 24, 8, 4
#: Characters after which a run without a space is cut.
LONG_WORD = 64
#: Sorts a null id behind all others.
_NO_ID = -(1 << 63)
#: Rows without an id share a key; they are dealt out by their text.
SALTS = 64
#: Documents that a task sketches, about: their cells fit in its memory.
TASK_ROWS = 1024
#: Cells of the first difference sketch for each paragraph of both versions; most that fails is tried again in parts.
SPACE = 4.0
#: Times that every table is peeled.
CYCLES = 2


def _runs(sentence: Column) -> Column:
    """A sentence's word runs: a word whose hash is 0 modulo RUN ends one, so an edit moves the borders next to it alone."""
    blank = r"[\s\p{Z}]+"

    def cut(words: Column) -> Column:
        n = F.size(words)
        ends = F.concat(F.filter(F.sequence(F.lit(1), n), lambda i: (i < n) & (F.pmod(F.xxhash64(F.element_at(words, i)), F.lit(RUN)) == 0)), F.array(n))
        return _bind(ends, lambda e: F.flatten(F.transform(e, lambda end, k: _spans(words, F.when(k == 0, F.lit(0)).otherwise(F.element_at(e, F.greatest(k, F.lit(1)))), end))))

    def _spans(words: Column, start: Column, end: Column) -> Column:
        return F.transform(F.sequence(start + 1, end, F.lit(RUN * RUNS)), lambda i: F.array_join(F.slice(words, i, F.least(F.lit(RUN * RUNS), end - i + 1)), " "))

    def split(words: Column) -> Column:
        shorter = F.split(F.regexp_replace(sentence, rf"(?s)([^\s\p{{Z}}]{{{LONG_WORD}}})(?=[^\s\p{{Z}}])", "$1 "), blank)
        over = F.exists(words, lambda x: F.length(x) >= LONG_WORD)
        return F.when(over, _bind(shorter, lambda w: F.when(F.size(w) > LONG_SENTENCE, cut(w)).otherwise(w))).when(F.size(words) > LONG_SENTENCE, cut(words)).otherwise(F.array(sentence))

    # Fewer characters hold neither that many words nor a long one.
    return F.when(F.length(sentence) <= 2 * LONG_SENTENCE, F.array(sentence)).otherwise(_bind(F.split(sentence, blank), split))


def part_digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's sentences and of the word runs of long ones, sorted; none for an empty text."""
    common = F.regexp_replace(text, SENTENCES, f"$1{END}")
    rare = reduce(or_, (F.contains(text, F.lit(c)) for c in SPACED + UNSPACED + BREAKS))
    marked = F.when(rare, F.regexp_replace(common, RARE_SENTENCES, f"$1$2{END}")).otherwise(common)
    sentences = F.filter(F.split(marked, END), lambda p: p != "")
    parts = F.filter(F.flatten(F.transform(sentences, _runs)), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p))))


def _bind(value: Column, use) -> Column:
    """`use(value)`, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(7)).bitwiseAND(F.lit(0xFFFFFFFF))


#: Bits of a key's hash at which the place in each table begins.
_SHIFTS = (3, 22, 41)


def _place(hashed: Column, table: int, cells: Column) -> Column:
    """A key's cell in a table of `cells` cells, a long, from the key's hash."""
    return F.pmod(F.shiftright(hashed, _SHIFTS[table]), cells)


def _items(digests: Column) -> Column:
    """Digests with their hash and check, computed once each."""
    return F.transform(digests, lambda d: F.struct(d.alias("k"), F.xxhash64(d, F.lit(3)).alias("x"), _check(d).alias("h")))


def _empty_cell() -> Column:
    return F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))


def _cell(c: Column, k: Column, h: Column) -> Column:
    return F.struct(c.alias("c"), k.alias("k"), h.alias("h"))


def _tables(cells: Column, cell_of) -> Column:
    """Three tables of `cells` cells, one after the other; `cell_of(table, place)` gives a cell."""
    places = F.sequence(F.lit(0).cast("long"), cells - 1)
    table = lambda t: F.transform(places, lambda i: cell_of(t, i))
    return F.concat(*map(table, range(3)))


def sketch(items: Column, cells: Column) -> Column:
    """Cells of count, key parity and check parity."""

    def fill(table: int, place: Column) -> Column:
        own = F.filter(items, lambda d: _place(d["x"], table, cells) == place)
        return F.aggregate(own, _empty_cell(), lambda a, d: _cell(a["c"] + 1, a["k"].bitwiseXOR(d["k"]), a["h"].bitwiseXOR(d["h"])))

    return _tables(cells, fill)


def subtract(a: Column, b: Column) -> Column:
    """Cell by cell; what both sketches hold cancels out."""
    return F.zip_with(a, b, lambda x, y: _cell(x["c"] - y["c"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))


def difference_sketch(items: Column, cells: Column) -> Column:
    """`subtract` of the sketches of two sides, filled in one go: items carry a sign `s`, 1 for the first side and -1 for the second."""

    def fill(table: int, place: Column) -> Column:
        own = F.filter(items, lambda d: _place(d["x"], table, cells) == place)
        return F.aggregate(own, _empty_cell(), lambda a, d: _cell(a["c"] + d["s"], a["k"].bitwiseXOR(d["k"]), a["h"].bitwiseXOR(d["h"])))

    return _tables(cells, fill)


def peel(difference: Column, cells: Column) -> Column:
    """(ok, found): the digests that a difference of sketches gives up, round by round, and whether it is empty then.

    A cell of count 1 or -1 whose check fits holds one digest; it is taken out of all its cells, which lays others bare.
    """

    def taken(state: Column, pure: Column) -> Column:
        def less(table: int, place: Column) -> Column:
            here = F.filter(pure, lambda p: _place(p["x"], table, cells) == place)
            cell = F.element_at(state["cells"], (cells * table + place + 1).cast("int"))
            return F.aggregate(here, cell, lambda a, p: _cell(a["c"] - p["s"], a["k"].bitwiseXOR(p["k"]), a["h"].bitwiseXOR(p["h"])))

        found = F.concat(state["found"], F.transform(pure, lambda p: p["k"]))
        return F.struct(_tables(cells, less).alias("cells"), found.alias("found"), F.lit(True).alias("go"))

    def bare(state: Column) -> Column:
        ready = F.filter(state["cells"], lambda c: (F.abs(c["c"]) == 1) & (_check(c["k"]) == c["h"]))
        return F.array_distinct(F.transform(ready, lambda c: F.struct(c["k"].alias("k"), c["c"].alias("s"), F.xxhash64(c["k"], F.lit(3)).alias("x"), c["h"].alias("h"))))

    start = F.struct(difference.alias("cells"), F.array().cast("array<bigint>").alias("found"), F.lit(True).alias("go"))
    # A round that finds nothing ends the peeling; no more rounds than cells can find anything.
    rounds = F.aggregate(
        F.sequence(F.lit(1), cells * 3),
        start,
        lambda s, _: F.when(
            s["go"],
            _bind(bare(s), lambda p: F.when(F.size(p) == 0, F.struct(s["cells"].alias("cells"), s["found"].alias("found"), F.lit(False).alias("go"))).otherwise(taken(s, p))),
        ).otherwise(s),
    )
    return _bind(rounds, lambda s: F.struct((~F.exists(s["cells"], lambda c: (c["c"] != 0) | (c["k"] != 0) | (c["h"] != 0))).alias("ok"), s["found"].alias("found")))


def _recovered(items: Column) -> Column:
    """How many digests the two sides of some signed items differ in: peeled, with twice the cells after each failure."""

    def attempt(cells: Column) -> Column:
        return _bind(peel(difference_sketch(items, cells), cells), lambda r: F.struct(r["ok"].alias("ok"), F.size(r["found"]).alias("n")))

    tried = F.aggregate(
        F.sequence(F.lit(0), F.lit(RETRIES)),
        F.struct(F.lit(False).alias("ok"), F.lit(0).alias("n")),
        lambda r, t: F.when(r["ok"], r).otherwise(_bind((F.lit(CELLS) * F.pow(F.lit(2), t)).cast("long"), attempt)),
    )
    side = lambda sign: F.transform(F.filter(items, lambda d: d["s"] == sign), lambda d: d["k"])
    direct = F.size(F.array_except(side(1), side(-1))) + F.size(F.array_except(side(-1), side(1)))
    return F.when(F.size(items) == 0, F.lit(0)).otherwise(_bind(tried, lambda r: F.when(r["ok"], r["n"]).otherwise(direct)))


def differing(a: Column, b: Column) -> Column:
    """The number of digests in one list of items but not the other.

    Larger lists are sketched in parts, dealt by the digest in two steps, so the work grows little faster than the lists; each
    part is peeled on its own.
    """
    signed = lambda items, s: F.transform(items, lambda d: F.struct(d["k"].alias("k"), d["x"].alias("x"), d["h"].alias("h"), F.lit(s).alias("s")))
    side = F.greatest(F.lit(1), F.ceil(F.sqrt((F.size(a) + F.size(b)) / PART_LOAD))).cast("long")

    def parts(both: Column, n: Column) -> Column:
        numbers = F.sequence(F.lit(0).cast("long"), n - 1)
        first = lambda g: F.filter(both, lambda d: F.pmod(d["k"], n) == g)
        row = lambda g: _bind(first(g), lambda own: F.transform(numbers, lambda h: F.filter(own, lambda d: F.pmod(F.shiftright(d["k"], 24), n) == h)))
        return F.flatten(F.transform(numbers, row))

    dealt = _bind(side, lambda n: _bind(F.concat(signed(a, 1), signed(b, -1)), lambda both: parts(both, n)))
    return F.aggregate(dealt, F.lit(0), lambda total, p: total + _recovered(p))


_ROW = ("k", "salt", "rid", "cells")
#: Tables 0 to 2 are the sketch of a row's own digests against the edited text's, 3 to 5 that against the next document's; then what either gave up, and the row's doc.
_FOUND, _DOC = (6, 7), 8


def _folded(entries: DataFrame) -> DataFrame:
    """Entries of one cell made one: counts added, parities by exclusive or; empty cells go."""
    cells = entries.groupBy(*_ROW, "table", "place", "doc").agg(
        F.sum("c").cast("int").alias("c"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"), F.sum("found").cast("int").alias("found"))
    return cells.where((F.col("c") != 0) | (F.col("key") != 0) | (F.col("check") != 0) | (F.col("table") >= _FOUND[0]))


def _shift(table: Column) -> Column:
    return F.when(table == 0, _SHIFTS[0]).when(table == 1, _SHIFTS[1]).otherwise(_SHIFTS[2])


def _cell_of(hashed: Column, table: Column) -> Column:
    """A digest's place in one of the three tables, from its hash."""
    return F.pmod(F.call_function("shiftright", hashed, _shift(F.pmod(table, F.lit(3)))), F.col("cells").cast("long")).cast("int")


def _sketched(rows: DataFrame, doc_type: str) -> DataFrame:
    """The cells of both difference sketches of each row.

    `rows` holds k, salt, rid, cells and doc (a struct with own, changed and following). Rows lie by k and salt, so nothing is moved; doc goes along as
    an entry of its own.
    """
    no_doc = F.lit(None).cast(doc_type)
    item = lambda side: lambda d: F.struct(F.lit(side).alias("side"), d.alias("key"), no_doc.alias("doc"))
    sides = [F.transform(f"doc.{c}", item(i)) for i, c in enumerate(("own", "changed", "following"))]
    head = F.array(F.struct(F.lit(3).alias("side"), F.lit(0).cast("long").alias("key"), F.col("doc").alias("doc")))
    tables = [range(6), range(3), range(3, 6), [_DOC]]
    lists = F.element_at(F.array(*(F.array(*map(F.lit, t)) for t in tables)), F.col("side") + 1)
    items = rows.select(*_ROW, F.explode(F.concat(head, *sides)).alias("i")).select(*_ROW, "i.*").select("*", F.explode(lists).alias("table"))
    is_doc = F.col("side") == 3
    sign = F.when(F.col("side") == 0, 1).when(is_doc, 0).otherwise(-1)
    place = F.when(is_doc, 0).otherwise(_cell_of(F.xxhash64("key", F.lit(3)), F.col("table")))
    check = F.when(is_doc, F.lit(0).cast("long")).otherwise(_check(F.col("key")))
    return _folded(items.select(*_ROW, "table", place.alias("place"), "doc", sign.alias("c"), "key", check.alias("check"), F.lit(0).alias("found")))


def _peeled(cells: DataFrame, table: int) -> DataFrame:
    """The digests that stand alone in a cell of one table of either sketch, taken out of all their cells and counted. A table holds a digest once."""
    mine = F.pmod("table", F.lit(3)) == table
    bare = (F.col("table") < _FOUND[0]) & mine & (F.abs("c") == 1) & (_check(F.col("key")) == F.col("check"))
    steps = F.explode(F.when(F.col("bare"), F.array(*map(F.lit, range(4)))).otherwise(F.array(F.lit(0))))
    rows = cells.select("*", bare.alias("bare")).select("*", steps.alias("j"))
    second = F.col("table") >= 3
    others = [t for t in range(3) if t != table]
    other = F.when(F.col("j") == 1, others[0]).otherwise(others[1]) + F.when(second, 3).otherwise(0)
    own, found = F.col("j") == 0, F.col("j") == 3
    stays = own & ~F.col("bare")
    moved = lambda c, v: F.when(stays, F.col(c)).when(own | found, F.lit(0)).otherwise(v)
    zero = F.lit(0).cast("long")
    entries = rows.select(
        *_ROW, F.when(own, F.col("table")).when(found, F.when(second, _FOUND[1]).otherwise(_FOUND[0])).otherwise(other).alias("table"), "place", "j",
        F.when(own, F.col("doc")).alias("doc"), moved("c", -F.col("c")).alias("c"), F.when(own & F.col("bare") | found, zero).otherwise(F.col("key")).alias("key"),
        F.when(own & F.col("bare") | found, zero).otherwise(F.col("check")).alias("check"), F.when(found, 1).when(own, F.col("found")).otherwise(0).alias("found"),
    )
    place = F.when(F.col("j") == 0, F.col("place")).when(F.col("j") == 3, 0).otherwise(_cell_of(F.xxhash64("key", F.lit(3)), F.col("table")))
    return _folded(entries.withColumn("place", place).drop("j"))


def recovered(rows: DataFrame, doc_type: str) -> DataFrame:
    """k, salt, rid, doc, and for both pairs (edited, next) the digests that peeling gave up (f_) and whether nothing is left of the sketch (ok_)."""
    cells = _sketched(rows, doc_type)
    for _ in range(CYCLES):
        for table in range(3):
            cells = _peeled(cells, table)
    table = F.col("table")
    left = {"edited": table < 3, "next": (table >= 3) & (table < _FOUND[0])}
    return cells.groupBy("k", "salt", "rid").agg(
        F.max("doc").alias("doc"), *(F.sum(F.when(table == t, F.col("found")).otherwise(0)).alias(f"f_{p}") for p, t in zip(left, _FOUND)),
        *((F.max(F.when(cond, 1).otherwise(0)) == 0).alias(f"ok_{p}") for p, cond in left.items())
    )


def likeness(a: Column, b: Column, ok: Column, found: Column) -> Column:
    """Share of common digests in all digests of two lists; 1 if both are empty. What the first sketch did not give up is tried again in larger ones."""
    sizes = F.size(a) + F.size(b)
    d = F.when(ok, found).otherwise(_bind(F.array(_items(a), _items(b)), lambda x: differing(x[0], x[1])))
    return F.when(sizes == 0, F.lit(1.0)).otherwise(_bind(d, lambda n: (sizes - n) / (sizes + n)))


def spelled(items: Column) -> Column:
    """The fingerprint: the base sketch's cells as text."""
    cell = lambda c: F.concat(F.hex(c["c"].cast("long")), F.lit("."), F.hex(c["k"]), F.lit("."), F.hex(c["h"]))
    return _bind(items, lambda own: F.array_join(F.transform(sketch(own, F.lit(CELLS).cast("long")), cell), ":"))


def _successors(ids: DataFrame) -> DataFrame:
    """(k, next): the next smaller id, and the largest after the smallest; no task sees more than a range of the ids."""
    down = F.desc("k")
    ranges = land(ids.distinct().repartitionByRange(down).sortWithinPartitions(down).withColumn("part", F.spark_partition_id()), "ids")
    heads = ranges.groupBy("part").agg(F.max("k").alias("head"))
    # One row for each partition of the range exchange.
    follow = heads.select("part", F.lead("head").over(W.orderBy("part")).alias("after"))
    top = ranges.agg(F.max("k")).first()[0]
    inside = ranges.withColumn("next", F.lead("k").over(W.partitionBy("part").orderBy(down)))
    return inside.join(follow, "part").select("k", F.coalesce("next", "after", F.lit(top)).alias("next"))


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next document's, in the order of
    descending doc_id, and after the last the first. A null text is empty; a null doc_id comes after all others. Rows
    that share an id are edited each, all by the same next document, of several that with the smallest beginning. The near
    columns compare the digests of the texts' parts: 1 for equal ones or two empty texts, 0 without a common one. Equal texts have equal fingerprints.

    Whole texts move once, keyed by id; then half texts and digests of the next document move to the document they edit. Sketches are filled and
    peeled where the rows then lie: every digest of a row is an entry of one cell in each of three tables, and each round folds the entries of a cell.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    salt = F.when(F.col("k") == _NO_ID, F.pmod(F.xxhash64("text"), F.lit(SALTS))).otherwise(F.lit(0)).cast("long").alias("salt")
    lengths = texts.select("k", F.length("text").alias("n")).groupBy("k").agg(F.max("n").alias("n"))
    follow = _successors(texts.select("k"))
    tasks = max(1, -(-docs.count() // TASK_ROWS))
    texts = texts.select("k", salt, "text").repartition(tasks, "k", "salt")
    salts = F.explode(F.when(F.col("k") == _NO_ID, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias("salt")
    wanted = follow.join(lengths, "k").select(F.col("next").alias("k"), F.col("k").alias("to"), F.floor(F.col("n") / 2).cast("int").alias("half"))
    sent = texts.join(wanted.select("*", salts), ["k", "salt"]).select("to", F.struct(F.substr("text", F.lit(1), F.col("half")).alias("piece"), part_digests(F.col("text")).alias("digests")).alias("sent"))
    sent = sent.withColumnRenamed("to", "k").select("*", salts).repartition(tasks, "k", "salt").groupBy("k", "salt").agg(F.min("sent").alias("sent"))
    rows = texts.join(sent, ["k", "salt"]).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars") - half), F.substr("sent.piece", F.lit(1), half)))
    doc = F.struct(
        F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        part_digests(F.col("text")).alias("own"), part_digests(F.col("edited")).alias("changed"), F.col("sent.digests").alias("following"),
    )
    rows = rows.select("k", "salt", F.monotonically_increasing_id().alias("rid"), doc.alias("doc"))
    most = F.size("doc.own") + F.greatest(F.size("doc.changed"), F.size("doc.following"))
    rows = rows.withColumn("cells", F.greatest(F.lit(2 * CELLS), F.ceil(most * (SPACE / 3)).cast("int")))
    found = recovered(rows, rows.schema["doc"].dataType.simpleString())
    own, changed, following = (F.col(f"doc.{c}") for c in ("own", "changed", "following"))
    return found.select(
        F.when(F.col("k") != _NO_ID, F.col("k")).alias("doc_id"), "doc.n_chars", "doc.edited_sha256",
        spelled(_items(own)).alias("fingerprint"), spelled(_items(changed)).alias("edited_fingerprint"),
        likeness(own, changed, F.col("ok_edited"), F.col("f_edited")).alias("near_edited"), likeness(own, following, F.col("ok_next"), F.col("f_next")).alias("near_next"),
    )
