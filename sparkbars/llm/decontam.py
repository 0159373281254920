"""Benchmark decontamination: hash-joined windows, literal and of templates whose numbers, names and units are typed placeholders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, lists, utf8
from .words import BYTE_VALUES, LOWER, PLACES, mix, prefix_hash, word_bounds

WIDTH = 8         # tokens of a window; an item of fewer tokens is one window of its own length
LITERALS = 4      # tokens of a window with placeholders that must not be placeholders; literal windows need none
LEAST_SHARE = .5  # part of an item's windows that make a document contaminated
RUN = 13          # tokens in a row that make a document contaminated as they are, the whole item if it is shorter
FILTER_BITS = 24  # a bitmap of 2 MB, whatever the size of the benchmark, tells which windows are worth joining

NUMBER, NAME, UNIT = (mix(np.array([k], np.uint64))[0] for k in (11, 12, 13))
#: Units of measure that may follow a number.
UNITS = ("km m cm mm mi miles mile meters meter metres metre feet foot ft inches inch yards yard kg g mg lb lbs pounds pound grams gram "
         "kilograms tons ton l ml liters liter litres litre gallons gallon s sec seconds second min minutes minute h hours hour days day "
         "weeks week months month years year percent degrees dollars dollar euros euro cents cent usd eur kmh mph").split()

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
JOIN = np.zeros(256, bool)
JOIN[[ord("."), ord(",")]] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?:;|\n\r\"'([{"]] = True


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums, down = prefix_hash(BYTE_VALUES[data])
    return mix((sums[ends] - sums[starts]) * down[starts])


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), LETTER[data])
    return np.unique(_hashed(data, starts, ends))


UNIT_HASHES = _unit_hashes()


def _inside(data: np.ndarray) -> np.ndarray:
    """Which bytes are part of a token; no-break spaces, Latin-1 and general punctuation (U+00A0 to U+00BF, U+2000 to U+207F) are not."""
    digit, inside = DIGIT[data], LETTER[data] | DIGIT[data]
    if len(data) > 2:
        inside[1:-1] |= JOIN[data[1:-1]] & digit[:-2] & digit[2:]
    for sign in (np.flatnonzero((data[:-1] == 0xC2) & (data[1:] >= 0xA0) & ~np.isin(data[1:], [0xAA, 0xB5, 0xBA])),
                 np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81)))):
        inside[sign] = inside[sign + 1] = False
        if len(sign) and data[sign[0]] == 0xE2:
            inside[sign + 2] = False
    return inside


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the hashes of their tokens, the same with placeholders, and the numbers of their texts.

    Tokens are runs of letters and digits in lower case, ß as ss; points and commas between digits belong to a number. A name is a capitalised token within a sentence, a unit one of UNITS right after a number.
    """
    data, offsets = utf8(texts)
    n = len(data)
    digit = DIGIT[data]
    starts, ends, owner = word_bounds(data, offsets, _inside(data))
    lower, lower_offsets = utf8(pc.replace_substring(pc.utf8_lower(texts), "ß", "ss"))
    plain = _hashed(lower, *word_bounds(lower, lower_offsets, _inside(lower))[:2])
    accented = np.zeros(n, bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    folded = LOWER[data] + (accented * np.uint8(32))
    if not len(starts):
        return plain, plain, owner
    capital = folded != data
    is_capital = capital[starts] | ((data[starts] == 0xC3) & capital[np.minimum(starts + 1, n - 1)])
    capitals = np.concatenate([[0], np.cumsum(capital)])
    one_capital = capitals[ends] - capitals[starts] == 1
    stops = np.concatenate([[0], np.cumsum(STOP[data])])
    after_stop = np.ones(len(starts), bool)
    after_stop[1:] = (stops[starts[1:]] > stops[ends[:-1]]) | (owner[1:] != owner[:-1])
    number = digit[starts]
    name = is_capital & one_capital & ~after_stop & (ends - starts > 1) & ~number
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1] & (owner[1:] == owner[:-1]) & np.isin(plain[1:], UNIT_HASHES)
    return plain, np.select([number, unit, name], [NUMBER, UNIT, NAME], plain), owner


def windows(plain: np.ndarray, typed: np.ndarray, owner: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows within one text, first all as literal tokens, then those with both placeholders and enough literal tokens: start tokens,
    hashes, whether enough tokens are literal."""
    count = max(0, len(typed) - width + 1)
    at = np.arange(count)
    literal = np.concatenate([[0], np.cumsum(plain == typed)])
    literal = literal[at + width] - literal[at]
    within = (owner[:count] == owner[width - 1:]) if count else np.zeros(0, bool)
    for values, good in ((plain, within), (typed, within & (literal >= LITERALS) & (literal < width))):
        sums = np.full(count, width, np.uint64)
        for place in range(width):
            sums += values[place:place + count] * PLACES[place + 20]
        yield at[good], mix(sums[good]), literal[good] >= LITERALS


def _rows(key: str, ids: pa.Array, found: list[tuple], owner: np.ndarray, plain: np.ndarray, typed: np.ndarray) -> pa.RecordBatch:
    """found: start tokens, hashes, whether enough tokens are literal, width, whether placeholders stand for tokens."""
    at, hashes, enough = (np.concatenate([np.empty(0, kind), *(f[k] for f in found)]) for k, kind in enumerate((np.int64, np.uint64, bool)))
    first = np.searchsorted(owner, np.arange(len(ids) + 1))
    slots, sizes = [np.empty(0, np.int64)], [np.zeros(1, np.int64)]
    for start, _, _, width, has_slots in found:
        cells = start[:, None] + np.arange(width)
        is_slot = (plain[cells] != typed[cells]) & has_slots
        slots.append(plain[cells][is_slot].view(np.int64))
        sizes.append(is_slot.sum(axis=1))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(owner[at] if len(at) else at)), pa.array(hashes.view(np.int64)), pa.array((at - first[owner[at]]) if len(at) else at),
         lists(np.concatenate(slots), np.cumsum(np.concatenate(sizes)), pa.int64()),
         pa.array(np.concatenate([np.empty(0, np.int64), *(np.full(len(f[0]), f[3]) for f in found)])), pa.array(enough)],
        [key, "window", "place", "slots", "width", "enough"])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        plain, typed, owner = tokens(block.column("text"))
        lengths = np.bincount(owner, minlength=len(block))
        found = []
        for width in range(1, WIDTH + 1):
            for has_slots, (at, hashes, enough) in enumerate(windows(plain, typed, owner, width)):
                own = (lengths[owner[at]] == width) | (width == WIDTH)
                found.append((at[own], hashes[own], enough[own], width, has_slots == 1))
        yield _rows("item_id", block.column("item_id"), found, owner, plain, typed)


def _document_windows(widths: list[int], bitmap: np.ndarray) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            plain, typed, owner = tokens(block.column("text"))
            found = []
            for width in widths:
                for has_slots, (at, hashes, enough) in enumerate(windows(plain, typed, owner, width)):
                    cell = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    hit = np.flatnonzero((bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1)
                    if width < WIDTH and not has_slots:  # a whole item: its first place in each text will do
                        hit = hit[np.unique(np.stack([owner[at[hit]].astype(np.uint64), hashes[hit]]), axis=1, return_index=True)[1]]
                    found.append((at[hit], hashes[hit], enough[hit], width, has_slots == 1))
            yield _rows("doc_id", block.column("doc_id"), found, owner, plain, typed)
    return scan


SCHEMA = "{} long, window long, place long, slots array<long>, width long, enough boolean"


def _distinct_pairs(column: Column) -> Column:
    return F.array_distinct(F.flatten(F.collect_set(column)))


def _in_a_row(places: Column, count: Column) -> Column:
    """Whether distinct places have `count` consecutive ones among them."""
    at = F.array_sort(places)
    return F.exists(F.transform(at, lambda p, k: F.coalesce(F.get(at, k + count - 1) - p, F.lit(-1))), lambda gap: gap == count - 1)


def _consistent(typed: Column) -> Column:
    """The windows of a diagonal's maximal runs within which each item value stands for one value, in place order; a run of fewer
    than RUN tokens is left out."""
    least = RUN - WIDTH + 1
    end = lambda state: F.when(F.size(state["run"]) >= least, F.concat(state["done"], state["run"])).otherwise(state["done"])

    def step(state: Column, window: Column) -> Column:
        clash = F.exists(window["pairs"], lambda p: F.exists(state["pairs"], lambda s: (s["item"] == p["item"]) & (s["own"] != p["own"])))
        return F.struct(F.when(clash, window["pairs"]).otherwise(F.array_union(state["pairs"], window["pairs"])).alias("pairs"),
                        F.when(clash, F.array(window)).otherwise(F.concat(state["run"], F.array(window))).alias("run"),
                        F.when(clash, end(state)).otherwise(state["done"]).alias("done"))

    whole = F.filter(F.array_sort(typed), lambda w: F.size(F.array_distinct(w["pairs"])) == F.size(F.array_distinct(w["pairs"]["item"])))
    none = F.slice(whole, 1, 0)
    return F.aggregate(whole, F.struct(F.flatten(none["pairs"]).alias("pairs"), none.alias("run"), none.alias("done")), step, end)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...), items(item_id, text, ...) -> (doc_id, item_id, n_windows, n_matched, share, reparameterised),
    one row for each document and each item it contains.

    Windows of eight tokens are joined by hash, once as they are in lower case and once with placeholders; an item of fewer tokens is
    one literal window. Matches on one diagonal (document place minus item place) are one occurrence; its windows with placeholders
    count if each value in the item's slots stands for one value in the document's. Where that fails, the occurrence is parted into
    maximal runs in which it holds, and those of 13 tokens or more count. A place of an item is matched by either kind.
    A document is contaminated where half of an item's windows are matched, or half of those with enough literal tokens, or 13
    tokens in a row as they are (the whole item if it is shorter); the counts and the share are those of the larger share.
    `reparameterised` tells whether some slot value differs.
    Null and empty texts match nothing; rows without doc_id or item_id are left out. Repeated rows give one result row. Other
    columns are ignored. To the driver come window widths and at most 2**24 filter cells.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    wanted = scratch.save(items.distinct().mapInArrow(_item_windows, SCHEMA.format("item_id")))
    total = wanted.groupBy("item_id").agg(
        F.count_distinct("place").alias("n_all"), F.count_distinct(F.when(F.col("enough"), F.col("place"))).alias("n_enough"))
    widths = sorted(r.width for r in wanted.select("width").distinct().collect())
    cells = wanted.select(F.shiftrightunsigned("window", 64 - FILTER_BITS).alias("cell")).distinct().toArrow()["cell"].to_numpy()
    bitmap = np.zeros(1 << FILTER_BITS, np.uint8)
    bitmap[cells] = 1
    seen = docs.mapInArrow(_document_windows(widths, np.packbits(bitmap, bitorder="little")), SCHEMA.format("doc_id")).drop("enough")
    wanted = wanted.join(total, "item_id").withColumnsRenamed({"place": "item_place", "slots": "item_slots"})
    met = seen.join(wanted, ["window", "width"]).where(F.size("slots") == F.size("item_slots"))
    place = F.struct(F.col("item_place").alias("place"), "enough")
    literal = F.size("slots") == 0
    totals = [F.first(c).alias(c) for c in ("n_all", "n_enough")]
    pairs = F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("own"))
    runs = met.groupBy("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal")).agg(
        F.collect_set(F.when(literal, place)).alias("literal"),
        F.collect_set(F.when(~literal, F.struct(F.col("item_place").alias("place"), "enough", pairs.alias("pairs")))).alias("typed"),
        _distinct_pairs(pairs).alias("pairs"), _distinct_pairs(F.col("item_slots")).alias("values"), *totals)
    runs = runs.withColumn("typed", F.when(F.size("pairs") == F.size("values"), F.col("typed")).otherwise(_consistent(F.col("typed"))))
    runs = runs.select(
        "doc_id", "item_id", "n_all", "n_enough",
        F.concat("literal", F.transform("typed", lambda w: F.struct(w["place"].alias("place"), w["enough"].alias("enough")))).alias("places"),
        F.exists("typed", lambda w: F.exists(w["pairs"], lambda p: p["item"] != p["own"])).alias("differs"),
        _in_a_row(F.col("literal")["place"], F.least(F.col("n_all"), F.lit(RUN - WIDTH + 1)).cast("int")).alias("in_a_row"))
    found = runs.groupBy("doc_id", "item_id").agg(
        _distinct_pairs(F.col("places")).alias("places"), F.bool_or("differs").alias("reparameterised"), F.bool_or("in_a_row").alias("in_a_row"), *totals)
    found = found.withColumns({
        "m_all": F.size("places").cast("long"), "m_enough": F.size(F.filter("places", lambda p: p["enough"])).cast("long")})
    by_all = F.col("m_all") * F.col("n_enough") >= F.col("m_enough") * F.col("n_all")
    found = found.withColumns({"n_windows": F.when(by_all, F.col("n_all")).otherwise(F.col("n_enough")),
                               "n_matched": F.when(by_all, F.col("m_all")).otherwise(F.col("m_enough"))})
    share = F.col("n_matched") / F.col("n_windows")
    return found.withColumn("share", share).where((F.col("share") >= LEAST_SHARE) | F.col("in_a_row")).select(
        "doc_id", "item_id", "n_windows", "n_matched", "share", "reparameterised")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that contain no item; rows without doc_id stay.

    The ids to leave out are written first: while their files are below Spark's threshold the texts are not shuffled.
    """
    found = Scratch(docs.sparkSession, "found").save(contamination(docs, items).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
