"""Benchmark decontamination by templates.

Numbers, names and units of a text are replaced by typed placeholders, so a benchmark
question whose parameters were changed keeps its template; numbers or names in a row are one. Windows of tokens are hashed,
the windows of the texts are joined to those of the benchmark, and a text holds an
item if it has enough of the item's windows, or a long run of them. The values behind the placeholders must
agree: one value of the item stands for one value of the text throughout.

Whether a capitalised word is a name cannot be told for certain, so items and texts are read
in several forms, and a window of one form counts where that of another is found.

The benchmark is sent to the tasks in blocks of bounded size, one pass over the texts
for each; a text's windows never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.scratch import Scratch
from broadsheet.llm.words import Words, letter_classes, mix, runs, shingles, words

WINDOW = 5  # tokens
LITERALS = 3  # tokens of a window that are no placeholders, at least
COVERAGE = 0.8  # share of an item's windows that a text must have
RUN = 50  # tokens of an item in a row that are enough, whatever share of it they are
AGREEMENT = 0.8  # share of repeated slots that must keep to one value
BLOCK = 1 << 20  # windows of a block of the benchmark
COMMON = 1 << 22  # bits of the set of words that are not taken for names

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
# Forms of a text: every capitalised word a name; those inside sentences that are not common words; no names;
# every token as it stands.
NAMES, USUAL, CASELESS, VERBATIM = FORMS = range(4)
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million"
UNITS = (
    "mm cm m km mg g kg t ml l s min h hour hours minute minutes second seconds day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres "
    "inch inches foot feet yard yards mile miles pound pounds ounce ounces gallon gallons mph kmh degrees percent "
    "dollar dollars cent cents euro euros"
)


@dataclass
class Tokens:
    """Tokens of a run of texts: hash with its placeholder put in, kind, hash of the value, and whether a sentence starts there."""

    hashes: np.ndarray
    kinds: np.ndarray
    values: np.ndarray
    opens: np.ndarray
    capital: np.ndarray
    origin: np.ndarray  # place of the token before a form was read
    first: np.ndarray


def _set_of(text: str) -> np.ndarray:
    return words(pa.array([text]), letter_classes()).hashes


def _raw(column: pa.Array) -> Tokens:
    """Tokens with numbers and units found; names are still literals."""
    found: Words = words(column, letter_classes())
    data, start, stop = found.data, found.start, found.stop
    ends = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b".?!:;\n", np.uint8)))])
    owner = found.owner()
    fresh = np.ones(len(start), bool)
    fresh[1:] = owner[1:] != owner[:-1]
    gap = np.zeros(len(start), np.int64)
    gap[1:] = start[1:] - stop[:-1]
    opens = fresh.copy()
    opens[1:] |= ends[start[1:]] > ends[stop[:-1]]
    letter = data[start] if len(start) else np.empty(0, np.uint8)
    second = data[np.minimum(start + 1, max(len(data) - 1, 0))] if len(start) else letter
    capital = ((letter >= 65) & (letter <= 90)) | ((letter == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    digits = (letter >= 48) & (letter <= 57)
    number = digits | np.isin(found.hashes, _set_of(NUMBER_WORDS))
    tail = np.zeros(len(start), bool)  # the part of a number behind its point or comma
    tail[1:] = digits[1:] & digits[:-1] & (gap[1:] == 1) & ~fresh[1:]
    keep = np.flatnonzero(~tail)
    kinds = np.where(number, NUMBER, LITERAL)[keep]
    after = np.zeros(len(keep), bool)
    after[1:] = (kinds[:-1] == NUMBER) & ~fresh[keep][1:]
    kinds[after & np.isin(found.hashes[keep], _set_of(UNITS)) & (kinds == LITERAL)] = UNIT
    first = np.searchsorted(keep, found.first)
    return Tokens(found.hashes[keep], kinds, found.hashes[keep], opens[keep], capital[keep], np.arange(len(keep)), first)


def _placed(tokens: Tokens, kinds: np.ndarray) -> np.ndarray:
    """Hashes with placeholders in the place of slots."""
    marks = mix(np.arange(1, 5, dtype=np.uint64))
    return np.where(kinds == LITERAL, tokens.hashes, marks[kinds])


def _read(tokens: Tokens, form: int, common: np.ndarray) -> Tokens:
    """The tokens in a form, names found, and names or numbers in a row put together within a sentence."""
    if form == VERBATIM:
        return replace(tokens, kinds=np.full_like(tokens.kinds, LITERAL))
    kinds, n = tokens.kinds, len(tokens.kinds)
    if form != CASELESS:
        name = tokens.capital & (kinds == LITERAL)
        if form == USUAL:
            known = (common[(tokens.hashes % np.uint64(COMMON)).astype(np.int64) >> 3] >> (tokens.hashes % np.uint64(8)).astype(np.uint8)) & 1
            name &= ~tokens.opens & (known == 0)
        kinds = np.where(name, NAME, kinds)
    goes_on = np.zeros(n, bool)
    goes_on[1:] = (kinds[1:] == kinds[:-1]) & np.isin(kinds[1:], (NUMBER, NAME)) & ~tokens.opens[1:]
    kept = np.flatnonzero(~goes_on)
    place = np.arange(n) - np.repeat(kept, np.diff(np.append(kept, n)))
    values = np.add.reduceat(mix(tokens.values + mix(place.astype(np.uint64))), kept) if n else tokens.values
    return Tokens(tokens.hashes[kept], kinds[kept], values, tokens.opens[kept], tokens.capital[kept], kept, np.searchsorted(kept, tokens.first))


def _windows(tokens: Tokens, form: int, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of windows of ``size`` tokens, where each text's begin, and which have enough literals.

    With ``size`` of WINDOW, a text that is shorter has one window, itself.
    """
    found = Words(_placed(tokens, tokens.kinds), tokens.first, tokens.hashes, tokens.hashes, tokens.hashes, tokens.first)
    literal = (tokens.kinds == LITERAL).astype(np.int64)
    hashes, first, literals = shingles(found, size, literal)
    counts = np.diff(tokens.first)
    if size == WINDOW:
        for i in np.flatnonzero((counts > 0) & (counts < WINDOW)):
            literals[first[i]] = LITERALS if literal[tokens.first[i] : tokens.first[i + 1]].any() else 0
    return hashes ^ mix(np.array([form + 1 + len(FORMS) * size], np.uint64)), first, literals >= min(LITERALS, size)


def _alone(tokens: Tokens) -> np.ndarray:
    """Whether each token is a sentence or a line by itself."""
    ends = np.ones(len(tokens.opens), bool)
    ends[:-1] = tokens.opens[1:]
    return tokens.opens & ends


def _common_words(benchmark: DataFrame) -> np.ndarray:
    """Bitmap of hashed words that the benchmark has in lower case."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _raw(batch.column(0))
            usual = np.unique(tokens.hashes[~tokens.capital] % np.uint64(COMMON)).astype(np.int64)
            yield pa.record_batch([pa.array(usual)], names=["place"])

    places = benchmark.select("text").mapInArrow(find, "place bigint").distinct().toArrow()["place"].to_numpy()
    flags = np.zeros(COMMON, np.uint8)
    flags[places] = 1
    return np.packbits(flags, bitorder="little")


def _item_windows(benchmark: DataFrame, common: np.ndarray) -> DataFrame:
    """item_id, for each form the values of the tokens and their places in the item, and the window hashes with their forms and places."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _raw(batch.column("text"))
            rows = {"item_id": [], "values": [], "origins": [], "hashes": [], "forms": [], "places": []}
            read = [_read(raw, form, common) for form in FORMS]
            listed = [(form, size, *_windows(read[form], form, size)) for form in FORMS for size in range(1, WINDOW + 1)]
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                windows = []
                if (raw.kinds[raw.first[i] : raw.first[i + 1]] == NUMBER).all():
                    continue
                for form, size, hashes, first, usable in listed:
                    if size < WINDOW and size != read[form].first[i + 1] - read[form].first[i]:
                        continue  # only a short item is looked up by its own length
                    windows += [(int(hashes[k].view(np.int64)), form, int(k - first[i])) for k in range(first[i], first[i + 1]) if usable[k]]
                parts = [slice(tokens.first[i], tokens.first[i + 1]) for tokens in read]
                rows["item_id"].append(item)
                rows["values"].append([tokens.values[part].view(np.int64) for tokens, part in zip(read, parts)])
                rows["origins"].append([tokens.origin[part] - raw.first[i] for tokens, part in zip(read, parts)])
                for k, name in enumerate(("hashes", "forms", "places")):
                    rows[name].append([w[k] for w in windows])
            yield pa.record_batch(
                [pa.array(rows["item_id"], batch.schema.field("item_id").type),
                 *(pa.array(rows[c], pa.list_(pa.list_(pa.int64()))) for c in ("values", "origins")),
                 *(pa.array(rows[c], pa.list_(pa.int64())) for c in ("hashes", "forms", "places"))],
                names=list(rows),
            )

    kind = dict(benchmark.dtypes)["item_id"]
    schema = (f"item_id {kind}, values array<array<bigint>>, origins array<array<bigint>>, "
              "hashes array<bigint>, forms array<bigint>, places array<bigint>")
    return benchmark.select("item_id", "text").mapInArrow(make, schema).filter("size(hashes) > 0")


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All places from each ``low`` up to its ``high``, one after the other."""
    sizes = high - low
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)


class _Block:
    """Items of the benchmark with their windows.

    A text can hold an item only if it has ``need`` different places of it. So it has one of
    the item's anchors, those places whose windows the fewest items share, all but ``need`` - 1
    of them; only these windows name items, so a window that many items share names few.
    Items whose windows in a form are the same, with slots that are equal to each other in the same way, share
    a sheet, which is compared with a text once for all of them.
    """

    def __init__(self, rows: list):
        self.ids = [r["item_id"] for r in rows]
        self.origins = [[np.array(o, np.int64) for o in r["origins"]] for r in rows]
        self.lengths = [[len(v) for v in r["values"]] for r in rows]
        self.sizes = [sorted({n[form] for n in self.lengths if 0 < n[form] < WINDOW}) + [WINDOW] for form in FORMS]
        listed = [(np.array(r["hashes"], np.int64).view(np.uint64), np.array(r["forms"], np.int64), np.array(r["places"], np.int64)) for r in rows]
        self.windows = [[np.unique(places[forms == form]) for form in FORMS] for _, forms, places in listed]
        self.first = np.concatenate([[0], np.cumsum([len(hashes) for hashes, _, _ in listed])])
        self.hashes = np.concatenate([hashes for hashes, _, _ in listed])
        self.item = np.repeat(np.arange(len(rows)), np.diff(self.first))
        self.origin = np.array([r["origins"][f][p] for r in rows for f, p in zip(r["forms"], r["places"])], np.int64)
        self.width = int(self.origin.max()) + 1
        fewest = np.array([min(len(w) for w in windows if len(w)) for windows in self.windows])
        self.need = np.minimum(np.ceil(COVERAGE * fewest), -(-RUN // WINDOW)).astype(np.int64)
        self.known, self.anchors, self.named = self._anchors()
        self.sheets, self.sheet = self._sheets(rows, listed)

    def _anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All hashes, sorted; hashes of the anchors, sorted, and the items that each names."""
        known, which, times = np.unique(self.hashes, return_inverse=True, return_counts=True)
        places, at = np.unique(self.item * self.width + self.origin, return_inverse=True)
        shared = np.zeros(len(places), np.int64)
        np.maximum.at(shared, at, times[which])
        item = places // self.width
        order = np.lexsort((places, shared, item))
        count = np.bincount(item, minlength=len(self.ids))
        rank = np.empty(len(places), np.int64)
        rank[order] = np.arange(len(places)) - np.repeat(np.cumsum(count) - count, count)
        chosen = np.flatnonzero((rank <= count[item] - self.need[item])[at])
        chosen = chosen[np.argsort(self.hashes[chosen], kind="stable")]
        return known, self.hashes[chosen], self.item[chosen]

    def _sheets(self, rows: list, listed: list) -> tuple[list, list]:
        """Hashes, sorted, places and slots of each sheet; the sheet of each item for each form."""
        numbers, sheets, of = {}, [], []
        for r, (hashes, forms, places) in zip(rows, listed):
            own = []
            for form in FORMS:
                here = np.flatnonzero(forms == form)
                here = here[np.lexsort((places[here], hashes[here]))]
                _, start, same = np.unique(np.array(r["values"][form], np.int64), return_index=True, return_inverse=True)
                parts = hashes[here], places[here], start[same]
                key = (form, *(part.tobytes() for part in parts))
                if key not in numbers:
                    numbers[key] = len(sheets)
                    sheets.append(parts)
                own.append(numbers[key])
            of.append(own)
        return sheets, of

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        where = np.searchsorted(self.known, hashes)
        return np.flatnonzero((where < len(self.known)) & (self.known[np.minimum(where, len(self.known) - 1)] == hashes))

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Items of which the window hashes of a text, sorted and different, show enough places."""
        low, high = np.searchsorted(self.anchors, hashes, "left"), np.searchsorted(self.anchors, hashes, "right")
        items = np.unique(self.named[_spread(low, high)])
        own = _spread(self.first[items], self.first[items + 1])
        where = np.minimum(np.searchsorted(hashes, self.hashes[own]), len(hashes) - 1)
        own = own[hashes[where] == self.hashes[own]]
        places = np.unique(self.item[own] * self.width + self.origin[own])
        seen = np.bincount(places // self.width, minlength=len(self.ids))
        return items[seen[items] >= self.need[items]]

    def held(self, hashes: np.ndarray, at: np.ndarray, forms: np.ndarray, read: list[Tokens], text: int) -> Iterator[tuple]:
        """Item, windows, found, coverage, slots, agreeing of the items that a text holds, given its hits sorted by form and hash."""
        cut = np.searchsorted(forms, np.arange(len(FORMS) + 1))
        compared = {}
        for item in self.candidates(np.unique(hashes)):
            matched = {}
            for form, sheet in enumerate(self.sheet[item]):
                if sheet not in compared:
                    own = slice(cut[form], cut[form + 1])
                    here = slice(read[form].first[text], read[form].first[text + 1])
                    compared[sheet] = self._compare(sheet, hashes[own], at[own], read[form].kinds[here], read[form].values[here].view(np.int64))
                if compared[sheet]:
                    matched[form] = compared[sheet]
            row = self._best(item, matched)
            if row:
                yield self.ids[item], *row

    def _compare(self, sheet: int, hashes: np.ndarray, at: np.ndarray, kinds: np.ndarray, values: np.ndarray) -> tuple | None:
        windows, places, slots = self.sheets[sheet]
        low, high = np.searchsorted(hashes, windows, "left"), np.searchsorted(hashes, windows, "right")
        if not (high > low).any():
            return None
        return _agreeing(np.repeat(places, high - low), at[_spread(low, high)], slots, kinds, values)

    def _best(self, item: int, matched: dict[int, tuple]) -> tuple | None:
        """windows, found, coverage, slots, agreeing of the form that shows most of the item, if it is held."""
        origins, windows, best = self.origins[item], self.windows[item], None
        starts = np.concatenate([origins[form][places] for form, (places, *_) in matched.items()])
        for form, (places, slots, agreed, longest) in matched.items():
            short = self.lengths[item][form] < WINDOW  # one window, the whole item
            count = len(places) if short else int(np.isin(origins[form][windows[form]], starts).sum())
            coverage = count / len(windows[form])
            if (coverage >= COVERAGE or longest >= RUN) and agreed >= AGREEMENT * slots and (best is None or coverage > best[2]):
                best = (len(windows[form]), count, coverage, slots, agreed)
        return best


def _usual(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which values are the commonest of their group, the least of those that are equally common. Groups are numbered from 0."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    begin = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])]))
    times = np.diff(np.append(begin, len(g)))
    ranked = begin[np.lexsort((v[begin], -times, g[begin]))]
    leads = np.concatenate([[True], g[ranked][1:] != g[ranked][:-1]])
    return value == v[ranked[leads]][group]


def _agreeing(places: np.ndarray, at: np.ndarray, item: np.ndarray, kinds: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, int, int, int]:
    """Item places of the windows whose slots agree; slots seen, slots that agree, and the most tokens in a row that such windows cover.

    ``places`` and ``at`` are where windows begin in the item and in the text, ``item`` tells equal tokens of the item.
    Windows at the same distance between item and text belong together. There, each
    value of the item stands for the text's value that it meets most.
    """
    length, size = len(item), min(WINDOW, len(item))
    right = np.ones((len(places), size), bool)
    p, a = places[:, None] + np.arange(size), at[:, None] + np.arange(size)
    slot = kinds[a] != LITERAL
    seen = agreed = 0
    if slot.any():
        each, which = np.unique(a[slot] * length + p[slot], return_inverse=True)
        there, here = each // length, each % length
        _, group = np.unique(((there - here + length) * 4 + kinds[there]) * length + item[here], return_inverse=True)
        agrees = _usual(group, values[there])
        right[slot] = agrees[which]
        seen, agreed = len(each), int(agrees.sum())
    own = right.all(axis=1)
    p, shift = places[own], (at - places)[own]
    if not len(p):
        return p, seen, agreed, 0
    order = np.lexsort((p, shift))
    p, shift = p[order], shift[order]
    begin = np.flatnonzero(np.concatenate([[True], (shift[1:] != shift[:-1]) | (p[1:] > p[:-1] + size)]))
    end = np.append(begin[1:], len(p)) - 1
    return np.unique(p), seen, agreed, int((p[end] + size - p[begin]).max())


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """Texts that hold a benchmark item, as they stand or with other parameters.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; other columns are not read.
    Returns doc_id, text_hash, item_id, windows (of the item), found (of them in the
    text, with agreeing slots), coverage, slots, agreeing: one row for each document and
    item that it holds; coverage is lower where a run of ``RUN`` tokens decides. Tokens are runs of letters or of digits, so punctuation and
    layout do not matter, nor does the case of A-Z, unless names are changed too: a name is
    told by its capital letter.
    Windows, slots and agreeing are those of the form that shows most of the item.

    Items dense in names and numbers are found as they stand. Items with fewer tokens than
    a window are found as they stand anywhere in a text, those of one word where it is a
    sentence or a line by itself, and with other
    parameters where they have ``LITERALS`` other words or are the whole text. Null and
    empty texts hold nothing, and null, empty or purely numeric items are held by none.
    Repeated documents are reported once for each different text of an id; repeated items
    once for each item_id. Rows without doc_id are reported with a null id. Empty tables
    give an empty result.
    """
    scratch = Scratch(docs, "leaks")
    shared = docs.sparkSession.sparkContext.broadcast(_common_words(benchmark))
    items = scratch.keep(_item_windows(benchmark, shared.value))
    total = items.agg(F.sum(F.size("hashes")).alias("n"), F.count("*").alias("items")).first()
    parts = max(1, -(-(total["n"] or 0) // block))
    doc_kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = (f"doc_id {doc_kind}, text_hash bigint, item_id {item_kind}, windows bigint, found bigint, "
              "coverage double, slots bigint, agreeing bigint")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = None
    for part in range(parts):  # a block holds about ``block`` windows; blocks are divided by the hash of the item
        listed = items.filter(F.pmod(F.xxhash64("item_id", "values"), F.lit(parts)) == part).collect()
        if not listed:
            continue
        sent = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in listed])
        one = scratch.keep(rows.mapInArrow(_search(shared, sent), schema).dropDuplicates(["doc_id", "text_hash", "item_id"]))
        sent.destroy()
        found = one if found is None else found.unionByName(one)
    shared.destroy()
    scratch.drop(items)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def _search(common, sent):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _Block(sent.value)
        for batch in batches:
            column, out = batch.column("text"), []
            for a, b in runs(column):
                raw = _raw(column.slice(a, b - a))
                read = [_read(raw, form, common.value) for form in FORMS]
                found = []
                for form, size in ((form, size) for form in FORMS for size in bench.sizes[form]):
                    hashes, first, usable = _windows(read[form], form, size)
                    hit = bench.hits(hashes)
                    hit = hit[usable[hit]]
                    owner = np.searchsorted(first, hit, "right") - 1
                    at = hit - first[owner]
                    if size == 1:
                        alone = _alone(read[form])[read[form].first[owner] + at]
                        hit, owner, at = hit[alone], owner[alone], at[alone]
                    found.append((owner, np.full(len(hit), form), hashes[hit], at))
                owner, forms, hashes, at = (np.concatenate(parts) for parts in zip(*found))
                order = np.lexsort((at, hashes, forms, owner))
                owner, forms, hashes, at = owner[order], forms[order], hashes[order], at[order]
                texts, begin = np.unique(owner, return_index=True)
                for i, low, high in zip(texts, begin, np.append(begin[1:], len(owner))):
                    out += [(a + i, *row) for row in bench.held(hashes[low:high], at[low:high], forms[low:high], read, i)]
            if out:
                index = pa.array([x[0] for x in out], pa.int64())
                yield pa.record_batch(
                    [batch.column("doc_id").take(index), batch.column("text_hash").take(index), pa.array([x[1] for x in out]),
                     *(pa.array([x[c] for x in out], pa.int64() if c != 4 else pa.float64()) for c in range(2, 7))],
                    names=["doc_id", "text_hash", "item_id", "windows", "found", "coverage", "slots", "agreeing"],
                )

    return search


def clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the texts in ``found``; all columns kept."""
    bad = found.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    rows = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    return rows.join(bad, F.col("_id").eqNullSafe(F.col("_bad_id")) & (F.col("_hash") == F.col("_bad_hash")), "left_anti").select("_doc.*")
