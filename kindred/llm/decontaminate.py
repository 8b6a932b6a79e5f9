"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so that a question and a
copy with other values give the same template.  Neighbouring words of a name
are one placeholder, however many there are; a capital letter tells a name, at
the start of a sentence too unless the word is one of OPENERS.  Windows of
template tokens are joined by hash.  Windows that lie on one alignment of document and item are
then checked together: the names and units that fill the item's slots must map
one to one to those that fill the document's.  Numbers needn't, since new values
may coincide or differ where the item's were equal.  Where a name or unit
conflicts, only the windows that hold it are taken out, and windows that are the
item's word for word stay.  What is left counts if it is more than what was
taken out, or if more than ENOUGH windows in a row are word for word; else the
match is chance.

Windows of the bare words in lower case, without types, are joined as well,
so that what the templates can't tell is found where it stands word for word:
windows with fewer than LITERALS literals, items in other case, items of any
length.  Each character of a script without spaces is a word.

Defined cases: null texts count as empty and match nothing; an item of fewer
tokens than the window is one window; templates with fewer than LITERALS literal
tokens tell nothing and are left to the windows of bare words; an item without
any word has no window, and a warning gives the number of such items
(``without_windows`` lists them); repeated rows of items count once, and items
of one id and several texts are one item with the windows of all; repeated rows
of documents give the same result for each text; null ids are ids; empty tables
give no rows.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.kernels import Lookup, Words, chunks, mix, powers, windows
from kindred.llm.runtime import ROW_KEY, TEXT, bounded, key_filter, passes, without, written

WINDOW = 8
LITERALS = 4
#: Share of an item's windows from which a document counts as contaminated, and number of windows (6: 13 tokens in a row) that is enough for any item.
COVERAGE, ENOUGH = 0.25, 6
#: Most windows of items that are broadcast with their slots (about 150 bytes each, 30 MB in all); beyond it what the documents hold of them is shuffled to the join.
MOST_BROADCAST = 200_000
#: Most distinct hashes of them that documents are held against exactly (128 bytes each in a worker); beyond it a filter of fixed size stands before the join.
MOST_KEYS = 500_000
LITERAL, NUMBER, NAME, UNIT = range(4)
#: Units of measure and money.
UNITS = """% mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ml l liter
liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh percent
dollar dollars cent cents euro euros usd eur gbp c f degree degrees watt watts volt volts amp amps hz khz mhz ghz kb mb gb tb byte bytes bit bits""".split()


#: Words that open sentences without being names, in four languages.
OPENERS = """a an the this that these those there here it he she we you they i one some any all no not each every both many most few other another such his her its our your
their my if when while where what which who whose whom why how as at by for from in into of on off over under to with without after before because since until although though
and or but so then than also now yet still again once only just even if is are was were be been do does did can could may might must shall should will would have has had let
find give given calculate compute determine show suppose assume consider write say use take make
le la les un une des ce cette ces il elle ils elles nous vous je on et ou mais si quand dans pour par avec sans sur
der die das ein eine einer er sie es wir ihr ich und oder aber wenn wie was wer wo im am auf mit von zu bei nach
el los las uno una unos unas ella ellos nosotros yo y o pero cuando en con por para sin sobre que""".split()


def _keys(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(Words(data, np.array([0, len(data)])).cores()[0])


def _capital(lead: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether a character, given by its first two bytes, is a capital of the Latin, Greek or Cyrillic alphabet."""
    latin = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (after <= 0x9E) & (after != 0x97))
    pairs = ((lead == 0xC4) | (lead == 0xC5)) & (after < 0xC0)
    # U+0139..U+0148 and U+0179..U+017E have their capitals at odd places, the rest of U+0100..U+017F at even ones
    odd = ((lead == 0xC4) & (after >= 0xB9)) | ((lead == 0xC5) & ((after <= 0x88) | ((after >= 0xB9) & (after <= 0xBE))))
    greek = ((lead == 0xCE) & (after >= 0x86) & (after <= 0xAB) & (after != 0x90)) | ((lead == 0xD0) & (after <= 0xAF))
    return latin | (pairs & ((after & 1 == 1) == odd) & ~((lead == 0xC5) & ((after == 0x89) | (after == 0xBF)))) | greek


def spaced(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space before and after each character of a script that is written without spaces."""
    if not (data >= 0xE0).any():
        return data, at
    next1 = np.append(data[1:], np.uint8(0))
    wide = ((data >= 0xE3) & (data <= 0xE9)) | ((data == 0xE2) & (next1 >= 0xBA)) | ((data == 0xEF) & (next1 >= 0xA4) & (next1 <= 0xBE))  # CJK, kana, full width
    wide |= ((data == 0xE0) & (next1 >= 0xB8) & (next1 <= 0xBB)) | ((data == 0xE1) & (((next1 >= 0x80) & (next1 <= 0x82)) | (next1 == 0x9E) | (next1 == 0x9F)))  # Thai, Lao, Burmese, Khmer
    far = (data == 0xF0) & (next1 >= 0xA0) & (next1 <= 0xB3)
    starts = np.sort(np.concatenate([np.flatnonzero(wide), np.flatnonzero(far)]))
    if not len(starts):
        return data, at
    ends = starts + np.where(data[starts] == 0xF0, 4, 3)
    cuts = np.concatenate([starts, ends])
    out = np.insert(data, cuts, np.uint8(32))
    # a space at the border of two texts: that before a first character belongs to its text, that after a last character to its own
    return out, at + np.searchsorted(starts, at, "left") + np.searchsorted(np.sort(ends), at, "right")


class Template:
    """Words of many texts (``core``, ``word_row``) and their template tokens.

    A token has a code, a slot value (0 for a literal, else its last two bits
    are the kind), its row, its kind and its first word (``word``);
    ``token`` is the token that each word belongs to.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray):
        data, at = spaced(data, at)
        words = Words(data, at)
        core, first, last, solid = words.cores()
        n = len(words)
        if not n:
            self.code = self.core = self.value = np.zeros(0, np.uint64)
            self.kind, self.row, self.word_row, self.word, self.token = [np.zeros(0, np.int64)] * 5
            return
        stops = np.concatenate([[0], np.cumsum((data == 46) | (data == 33) | (data == 63) | (data == 58))])
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        opens = np.ones(n, bool)  # whether a word opens a sentence
        opens[1:] = (words.row[1:] != words.row[:-1]) | (stops[words.starts[1:]] > stops[np.maximum(last[:-1] + 1, words.starts[:-1])]) | (lines[words.starts[1:]] > lines[words.ends[:-1]])
        gaps = np.ones(n, bool)  # whether a mark stands between a word and the one before it
        gaps[1:] = (last[:-1] + 1 < words.ends[:-1]) | (first[1:] > words.starts[1:])
        kept = np.flatnonzero(solid)
        breaks = np.cumsum(opens | gaps | ~solid)[kept]
        core, first, row, opens = core[solid], first[solid], words.row[solid], opens[solid]
        self.core, self.word_row = core, row
        lead = data[first]
        after = data[np.minimum(first + 1, len(data) - 1)]
        upper = _capital(lead, after)
        kind = np.where(upper, NAME, LITERAL)
        if len(core):
            start = np.flatnonzero(opens & upper)
            kind[start[Lookup(_keys(OPENERS)).find(core[start]) >= 0]] = LITERAL
        kind[(lead >= 48) & (lead <= 57)] = NUMBER
        if len(core):
            unit = Lookup(_keys(UNITS[1:])).find(core[1:]) >= 0
            kind[1:][unit & (kind[:-1] == NUMBER) & (row[1:] == row[:-1]) & (kind[1:] == LITERAL)] = UNIT
        new = np.ones(len(core), bool)  # a name goes on over words that no mark parts
        new[1:] = (kind[1:] != NAME) | (kind[:-1] != NAME) | (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])
        self.word = np.flatnonzero(new)
        self.token = np.cumsum(new) - 1
        self.kind, self.row = kind[self.word], row[self.word]
        whole = core[self.word]
        long = np.flatnonzero(np.diff(np.append(self.word, len(core))) > 1)
        if len(long):
            place = np.arange(len(core)) - self.word[self.token]
            sums = np.add.reduceat(core * powers(int(place.max()) + 1)[place], self.word)
            whole[long] = mix(sums[long])
        types = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        self.code = np.where(self.kind == LITERAL, whole, types[self.kind])
        self.value = np.where(self.kind == LITERAL, np.uint64(0), whole & ~np.uint64(3) | self.kind.astype(np.uint64))

    def sizes(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and words of each row."""
        return np.bincount(self.row, minlength=rows), np.bincount(self.word_row, minlength=rows)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first token of each window of templates with enough literals, or, of a negative width, hash and first word of windows of bare words."""
        if width < 0:
            return windows(self.core, self.word_row, -width)
        hashes, at = windows(self.code, self.row, width)
        literal = np.concatenate([[0], np.cumsum(self.kind == LITERAL)])
        enough = literal[at + width] - literal[at] >= LITERALS
        return hashes[enough], at[enough]


#: Of a window: its width (negative for bare words), hash, first token and first word within the text, and slots.
SCHEMA = "width int, hash long, position long, origin long, slots array<long>"


def _rows(batch, width, t: Template, hashes, at):
    """Arrow rows of windows: the batch's own columns, then SCHEMA."""
    token = at if width > 0 else t.token[at]
    word = t.word[at] if width > 0 else at
    row = t.row[token]
    n = max(width, 0)  # bare words have no slots
    slots = t.value[at[:, None] + np.arange(n)].view(np.int64).ravel() if n else np.zeros(0, np.int64)
    take = pa.array(row)
    own = [batch.column(i).take(take) for i in range(batch.num_columns - 1)]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * n), pa.array(slots))
    place = [x - np.searchsorted(own_row, np.arange(batch.num_rows))[row] for x, own_row in ((token, t.row), (word, t.word_row))]
    names = batch.schema.names[:-1] + ["width", "hash", "position", "origin", "slots"]
    return pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(at), width, np.int32)), pa.array(hashes.view(np.int64)), *map(pa.array, place), lists], names)


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(item, SCHEMA) of every window of every item; an item of fewer tokens, or words, is one window.  ``width`` is negative for windows of bare words."""

    def run(batches):
        for batch, data, at in chunks(batches, TEXT):
            t = Template(data, at)
            for n, row, sign in zip(t.sizes(batch.num_rows), (t.row, t.word_row), (1, -1), strict=True):
                for w in [width, *np.unique(n[(n > 0) & (n < width)]).tolist()]:
                    hashes, where = t.windows(sign * w)
                    whole = (n[row[where]] == w) | (w == width)
                    yield _rows(batch, sign * w, t, hashes[whole], where[whole])

    given = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias(TEXT)).distinct()
    kind = given.schema["item"].dataType.simpleString()
    return given.mapInArrow(run, f"item {kind}, {SCHEMA}")


def document_windows(docs: DataFrame, id_col: str, text_col: str, widths: list[int], wanted, exact: bool) -> DataFrame:
    """(id, ROW_KEY, SCHEMA) of the windows of documents whose hash is among ``wanted``: a broadcast of hashes if ``exact``, else of a filter."""

    def run(batches):
        known = Lookup(wanted.value) if exact else None
        for batch, data, at in chunks(batches, TEXT):
            t = Template(data, at)
            for w in widths:
                hashes, where = t.windows(w)
                hit = known.find(hashes) >= 0 if exact else passes(wanted.value, hashes.view(np.int64))
                if hit.any():
                    yield _rows(batch, w, t, hashes[hit], where[hit])

    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(ROW_KEY), F.col(text_col).alias(TEXT))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, {ROW_KEY} long, {SCHEMA}")


def _same(window: Column) -> Column:
    """Whether the slots of a window are filled as in the item."""
    return F.forall(window["pairs"], lambda x: x["theirs"] == x["slots"])


def consistent(alignments: DataFrame, enough: int) -> DataFrame:
    """Alignments with those of their ``windows`` (place, typed, pairs) that hold no conflicting name or unit; those left to chance are dropped."""
    fixed = F.filter(F.array_distinct(F.flatten("windows.pairs")), lambda x: x["theirs"].bitwiseAND(F.lit(3).cast("long")) != NUMBER)
    n = F.size("fixed")
    one_to_one = (F.size(F.array_distinct("fixed.theirs")) == n) & (F.size(F.array_distinct("fixed.slots")) == n)
    clash = F.filter("fixed", lambda x: F.exists("fixed", lambda y: (x["theirs"] == y["theirs"]) != (x["slots"] == y["slots"])))
    out = alignments.withColumn("fixed", fixed).withColumn("clash", F.when(~one_to_one, clash))
    good = F.filter("windows", lambda w: _same(w) | ~F.arrays_overlap(w["pairs"], F.col("clash")))
    out = out.withColumn("good", F.when(F.col("clash").isNull(), F.col("windows")).otherwise(good))
    out = out.withColumn("verbatim", F.when(F.col("clash").isNotNull(), F.array_sort(F.array_distinct(F.filter("good", _same)["place"]))))
    in_a_row = F.array_contains(F.transform("verbatim", lambda x, i: F.coalesce(F.get("verbatim", i + enough) == x + enough, F.lit(False))), True)
    left = F.col("clash").isNull() | (2 * F.size(F.array_distinct("good.place")) > F.size(F.array_distinct("windows.place"))) | in_a_row
    return out.filter(left).withColumn("windows", F.col("good")).drop("fixed", "clash", "good", "verbatim")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW, coverage: float = COVERAGE, enough: int = ENOUGH, most_broadcast: int = MOST_BROADCAST, most_keys: int = MOST_KEYS) -> DataFrame:
    """(id, ROW_KEY, item, n_windows, item_windows, coverage, reparameterised) of each document and item it holds.

    Windows count by the word of the item that they start at.  Two windows lie
    on one alignment if their first tokens are equally far apart in document
    and item, so that a name of another length doesn't part it.
    ``reparameterised``: some slot is filled with another value than in the item.
    """
    spark = docs.sparkSession
    bounded(spark)
    items = written(item_windows(benchmark, item_col, item_text, width).distinct(), "item-windows")
    shape = items.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("hash").alias("n"), F.collect_set("width").alias("widths"), F.count_distinct(F.struct("item")).alias("items")).first()
    small, exact = shape["rows"] <= most_broadcast, shape["n"] <= most_keys
    if lost := benchmark.select(item_col).distinct().count() - shape["items"]:
        logging.getLogger(__name__).warning("%d benchmark items have no word and can't be found", lost)
    if exact:
        keys = items.select("hash").distinct().toArrow()["hash"].to_numpy()  # most_keys at most
        wanted = spark.sparkContext.broadcast(keys.view(np.uint64) if len(keys) else np.zeros(0, np.uint64))
    else:
        wanted = spark.sparkContext.broadcast(key_filter(items, "hash"))
    found = document_windows(docs, id_col, text_col, sorted(shape["widths"]) or [width], wanted, exact)
    right = items.select("item", "width", "hash", F.col("position").alias("start"), F.col("origin").alias("place"), F.col("slots").alias("theirs"))
    hits = found.drop("origin").join(F.broadcast(right) if small else right, ["width", "hash"])
    pairs = F.filter(F.arrays_zip("theirs", "slots"), lambda x: x["theirs"] != 0)
    window = F.struct(F.col("place"), (F.col("width") > 0).alias("typed"), pairs.alias("pairs"))
    whole = hits.groupBy("id", ROW_KEY, "item", (F.col("position") - F.col("start")).alias("shift")).agg(F.collect_set(window).alias("windows"))
    whole = consistent(whole, enough)
    by_item = whole.groupBy("id", ROW_KEY, "item").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("windows.place")))).cast("long").alias("n_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.filter("windows", lambda w: w["typed"])["place"])))).alias("n_typed"),
        F.max(F.exists("windows", lambda w: ~_same(w))).alias("reparameterised"),
    )
    totals = items.groupBy("item").agg(F.count_distinct("origin").alias("item_windows"), F.count_distinct(F.when(F.col("width") > 0, F.col("origin"))).alias("item_typed"))
    same = by_item.join((F.broadcast(totals) if small else totals).withColumnRenamed("item", "__item"), F.col("item").eqNullSafe(F.col("__item")))
    typed = F.coalesce(F.try_divide("n_typed", "item_typed"), F.lit(0.0))
    same = same.withColumn("coverage", F.greatest(F.col("n_windows") / F.col("item_windows"), typed)).filter((F.col("coverage") >= coverage) | (F.col("n_windows") >= enough))
    return same.select(F.col("id").alias(id_col), ROW_KEY, F.col("item").alias(item_col), "n_windows", "item_windows", "coverage", "reparameterised")


def without_windows(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """Rows of ``benchmark`` whose text has no word, which nothing can hold."""
    found = item_windows(benchmark, item_col, item_text, width).select("item").distinct()
    return benchmark.join(found, F.col(item_col).eqNullSafe(F.col("item")), "left_anti")


def keep(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` that hold no item of ``benchmark``, with the columns of ``docs``."""
    losers = contaminated(docs, benchmark, id_col, text_col, **options).select(id_col, ROW_KEY).distinct()
    return without(docs, written(losers, "contaminated"), id_col, text_col)
