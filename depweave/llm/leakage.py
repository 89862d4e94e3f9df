"""Evaluation texts leaking into training text.

Q-gram lemma filtering. A passage of L letters that occurs with at most k
edits shares at least L - q + 1 - k * q of its q-grams with the document, all
within a band of k + 1 diagonals. Q-grams of the held-out items are indexed;
documents look theirs up, count hits in overlapping diagonal bands, keep the
regions that reach the bound, and verify them by alignment within the band.

Both sides are reduced to letters and digits written together, with word starts
kept beside, so one index serves scripts with and without blanks.

Items of up to a stated number of characters are sent to all workers as one
index, which each builds once; the documents are read once and not shuffled.
Beyond it the q-grams of both sides meet by a join, behind a filter of fixed size
that keeps the grams no item has from being shuffled; hits are counted by
document, item and band, and only the regions that reach the bound bring the
texts of both sides together again.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.session import materialize

Q = 16
BLOCK_CHARS = 8_000_000
LETTERS_AT_ONCE = 1 << 20
FILTER_BITS = 27  # the filter of item grams has 2**27 bits, 16 MB, whatever the number of items
_MULT = 0x9E3779B97F4A7C15
_FORMAT = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf") + "]+")
_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Longest runs of letters and digits after NFKC, without format characters, case folded."""
    t = unicodedata.normalize("NFKC", text)
    if not t.isascii():
        t = _FORMAT.sub("", t)
    return _WORDS.findall(t.casefold())


def letters(ws: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(ws).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def starts(ws: Sequence[str]) -> np.ndarray:
    """Positions at which words start, and the end of the last."""
    return np.concatenate([[0], np.cumsum([len(w) for w in ws], dtype=np.int64)]).astype(np.int64)


def gram_hashes(a: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q-gram; pieces of doubling length are combined, so the cost follows log q."""
    if len(a) < q:
        return np.empty(0, np.uint64)
    power, piece, length = _MULT, (a + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    out, have = None, 0
    bits = q
    while bits:
        if bits & 1:
            if out is None:
                out, have = piece[: len(a) - length + 1], length
            else:
                n = len(a) - have - length + 1
                out = out[:n] * np.uint64(pow(_MULT, length, 1 << 64)) + piece[have : have + n]
                have += length
        bits >>= 1
        if bits:
            n = len(a) - 2 * length + 1
            piece = piece[:n] * np.uint64(power) + piece[length : length + n]
            power = power * power % (1 << 64)
            length *= 2
    out = out ^ (out >> np.uint64(31))
    return out * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Index:
    """Q-grams of a block of items, with what verification needs."""

    q: int
    edits: int
    ids: list
    text: list[np.ndarray]
    at: list[np.ndarray]
    run: np.ndarray  # consecutive words wanted, 0 where letters are counted
    least: np.ndarray  # letters of the shortest passage
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    seen: np.ndarray


def measure(t: str | None, by_letters: bool, min_words: int, min_letters: int) -> tuple[list[str], np.ndarray, int]:
    """Words of an item, where they start, and the letters of its shortest passage (0: too short for one)."""
    ws = words(t or "")
    s = starts(ws)
    if by_letters:
        return ws, s, min_letters if s[-1] >= min_letters else 0
    return ws, s, int((s[min_words:] - s[:-min_words]).min()) if len(ws) >= min_words else 0


def build_index(items: Sequence[tuple[object, str | None, bool]], min_words: int, min_letters: int, edits: int = 0, q: int = Q) -> Index | None:
    """Index of (id, text, counted by letters). Items too short for a passage are left out; None if none is left."""
    ids, text, at, run, least = [], [], [], [], []
    for i, t, by_letters in items:
        ws, s, short = measure(t, by_letters, min_words, min_letters)
        if short:
            ids.append(i)
            text.append(letters(ws))
            at.append(s)
            run.append(0 if by_letters else min_words)
            least.append(short)
    if not ids:
        return None
    # with k edits a passage has a piece of L / (k + 1) letters without one
    q = max(1, min(q, min(least) // (edits + 1)))
    hashes = [gram_hashes(a, q) for a in text]
    h = np.concatenate(hashes)
    item = np.repeat(np.arange(len(ids)), [len(x) for x in hashes])
    pos = np.concatenate([np.arange(len(x)) for x in hashes])
    order = np.argsort(h, kind="stable")
    keys, first = np.unique(h[order], return_index=True)
    seen = np.zeros(1 << 22, bool)
    seen[(keys >> np.uint64(42)).astype(np.int64)] = True
    return Index(q, edits, ids, text, at, np.array(run), np.array(least), keys, np.append(first, len(h)), item[order], pos[order], seen)


def _runs(eq: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], eq.view(np.int8), [0]])))
    return edge.reshape(-1, 2)


def _exact(x: Index, k: int, doc: np.ndarray, begins: np.ndarray, diag: int) -> bool:
    """Alignment within a band of width 0: whether item k's passage lies on the diagonal. ``begins`` marks word starts in the document."""
    item, s = x.text[k], x.at[k]
    lo, hi = max(0, -diag), min(len(item), len(doc) - diag)
    for a, b in _runs(item[lo:hi] == doc[lo + diag : hi + diag]) + lo:
        if not x.run[k]:
            if b - a >= x.least[k]:
                return True
            continue
        i, j = int(np.searchsorted(s, a)), int(np.searchsorted(s, b, side="right")) - 1
        if j - i < x.run[k]:
            continue
        # a word is matched if the document has starts at both its ends and none between
        own = begins[s[i] + diag : s[j] + diag + 1].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(own)])
        rel = s[i : j + 1] - s[i]
        whole = (own[rel[:-1]] == 1) & (own[rel[1:]] == 1) & (total[rel[1:]] - total[rel[:-1]] == 1)
        if any(d - c >= x.run[k] for c, d in _runs(whole)):
            return True
    return False


def banded_distance(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Least edits that turn ``a`` into some stretch of ``b`` which starts within ``band`` of its beginning; more than ``band`` if none."""
    big = band + 1
    row = np.zeros(len(b) + 1, np.int64)
    row[2 * band + 1 :] = big
    for i in range(1, len(a) + 1):
        lo, hi = max(0, i - 1), min(len(b), i + 2 * band)
        new = np.full(len(b) + 1, big)
        if lo == 0:
            new[0] = i
        j = np.arange(max(1, lo), hi + 1)
        new[j] = np.minimum(row[j - 1] + (b[j - 1] != a[i - 1]), row[j] + 1)
        for jj in j:  # insertions run along the row, at most 2 * band + 1 cells
            if new[jj - 1] + 1 < new[jj]:
                new[jj] = new[jj - 1] + 1
        row = new
        if row.min() > band:
            return big
    return int(row.min())


def _near(x: Index, k: int, doc: np.ndarray, diag: int) -> bool:
    """Whether a passage of item k lies within the band of ``edits`` around the diagonal.

    A region's count is of the whole item; here the bound is asked of each
    passage, by the q-grams of its own that lie in the band. Those that reach it
    are aligned at once: cell t of a row stands for the document's letter t
    places behind the passage's own, and each row is one step for all.
    """
    item, s, e, q = x.text[k], x.at[k], x.edits, x.q
    hit = np.zeros(len(item) + 1, np.int64)
    for d in range(diag, diag + 2 * e + 1):
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        if hi - lo >= q:
            same = np.concatenate([[0], np.cumsum(item[lo:hi] == doc[lo + d : hi + d])])
            hit[lo + 1 : hi - q + 2] |= same[q:] - same[:-q] == q
    held = np.cumsum(hit)
    if x.run[k]:
        a, b = s[: len(s) - x.run[k]], s[x.run[k] :]
    else:
        a = np.arange(len(item) - x.least[k] + 1)
        b = a + x.least[k]
    enough = held[np.maximum(b - q + 1, a)] - held[a] >= np.maximum(1, b - a - q + 1 - e * q)
    a, b = a[enough], b[enough]
    if not len(a):
        return False
    lo, hi = a + diag - 2 * e, b + diag + 2 * e
    there = np.clip(hi, 0, len(doc)) - np.clip(lo, 0, len(doc)) >= b - a - e
    a, b, lo = a[there], b[there], lo[there]
    if not len(a):
        return False
    cells = 4 * e + 2  # one more before the first letter a passage may start at
    t = np.arange(cells) - 1
    far = e + 1
    cost = np.where(t >= 0, 0, far)[None].repeat(len(a), 0)
    length, best = b - a, np.full(len(a), far)
    for i in range(1, int(length.max()) + 1):
        live = np.flatnonzero(length >= i)
        at = lo[live, None] + i - 1 + t[None]
        ch = doc[np.clip(at, 0, len(doc) - 1)]
        other = (at < 0) | (ch != item[a[live] + i - 1][:, None])
        row = cost[live]
        new = np.minimum(row + other, np.append(row[:, 1:] + 1, np.full((len(live), 1), far), 1))
        for c in range(1, cells):
            new[:, c] = np.minimum(new[:, c], new[:, c - 1] + 1)
        new[at >= len(doc)] = far
        new = np.minimum(new, far)
        cost[live] = new
        done = live[length[live] == i]
        best[done] = cost[done].min(1)
        if (cost[live].min(1) > e).all():
            break
    return bool((best <= e).any())


def find(x: Index, texts: Sequence[str | None]) -> list[tuple[int, int]]:
    """(text number, item number) of all leaks in some texts."""
    ws = [words(t) if t else [] for t in texts]
    arrays = [letters(w) for w in ws]
    found: list[tuple[int, int]] = []
    i = 0
    while i < len(arrays):
        j, size = i, 0
        while j < len(arrays) and (j == i or size + len(arrays[j]) <= LETTERS_AT_ONCE):
            size += len(arrays[j]) + 1
            j += 1
        found += [(i + d, k) for d, k in _find_some(x, arrays[i:j], ws[i:j])]
        i = j
    return found


def _find_some(x: Index, arrays: list[np.ndarray], ws: list[list[str]]) -> set[tuple[int, int]]:
    gap = np.array([1 << 33], np.uint64)
    stream = np.concatenate([v for a in arrays for v in (a, gap)])
    base = np.concatenate([[0], np.cumsum([len(a) + 1 for a in arrays])])
    h = gram_hashes(stream, x.q)
    at = np.flatnonzero(x.seen[(h >> np.uint64(42)).astype(np.int64)])
    if not len(at):
        return set()
    slot = np.searchsorted(x.keys, h[at])
    slot[slot == len(x.keys)] = 0
    good = x.keys[slot] == h[at]
    at, slot = at[good], slot[good]
    n = x.first[slot + 1] - x.first[slot]
    if not n.sum():
        return set()
    where = np.repeat(at, n)
    entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(x.first[slot], n)
    doc = np.searchsorted(base, where, side="right") - 1
    item = x.item[entry]
    diag = where - base[doc] - x.pos[entry]
    # overlapping bands: band b holds the diagonals from b * w up to, without it, b * w + w + edits, so any w diagonals in a row
    # lie in one; hits on the first ``edits`` diagonals of a band belong to the band before as well
    w = x.edits + 1
    band = diag // w
    if x.edits:
        both = diag % w < x.edits
        doc, item, band = np.append(doc, doc[both]), np.append(item, item[both]), np.append(band, band[both] - 1)
    found: set[tuple[int, int]] = set()
    reach = np.maximum(1, x.least - x.q + 1 - x.edits * x.q)
    begun: dict[int, np.ndarray] = {}
    key = np.stack([doc, item, band])
    order = np.lexsort(key[::-1])
    key = key[:, order]
    edge = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
    count = np.diff(np.append(edge, key.shape[1]))
    for e in edge[count >= reach[key[1, edge]]]:
        d, k, b = (int(v) for v in key[:, e])
        if (d, k) in found:
            continue
        if x.edits:
            if _near(x, k, arrays[d], b * w):
                found.add((d, k))
            continue
        if d not in begun:
            begun[d] = np.zeros(len(arrays[d]) + 1, bool)
            begun[d][starts(ws[d])] = True
        if _exact(x, k, arrays[d], begun[d], b):
            found.add((d, k))
    return found


def leaks(
    docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, by_letters: str, min_words: int = 13, min_letters: int = 40, edits: int = 0, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc, item): the documents that hold a passage of an item, once for each item that shares it.

    A passage is ``min_words`` consecutive words, or ``min_letters``
    consecutive letters and digits where the item's column ``by_letters`` is
    true. With ``edits`` above 0 a passage may differ in so many letters.
    Null and empty texts match nothing; equal documents and equal items each
    give their rows; items shorter than a passage match nothing. Ids should be
    unique: rows of one id are told as one.

    Items of at most ``block_chars`` characters are sent to all executors;
    more of them meet the documents by a join on q-grams.
    """
    some = items.select(F.col(item).alias("item_"), F.col(item_text).alias("t_"), F.coalesce(F.col(by_letters), F.lit(False)).alias("b_")).where("t_ is not null")
    total = some.agg(F.sum(F.length("t_"))).first()[0] or 0
    d = docs.select(F.col(doc).alias("d_"), F.col(text).alias("t_"))
    kinds = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    if total <= block_chars:
        out = _scan(d, [(r[0], r[1], r[2]) for r in some.collect()], kinds, min_words, min_letters, edits)
    else:
        out = _join(d, some, kinds, min_words, min_letters, edits)
    return out.select(F.col("d_").alias(doc), F.col("item_").alias(item))


#: Indexes a worker has built, by the id of what was sent; a worker serves many tasks.
_INDEXES: OrderedDict[tuple, Index | None] = OrderedDict()


def _scan(d: DataFrame, rows: list[tuple], kinds: tuple[str, str], min_words: int, min_letters: int, edits: int) -> DataFrame:
    sent = d.sparkSession.sparkContext.broadcast(rows)
    number = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from depweave.llm import leakage

        held = leakage._INDEXES  # of the worker's module, not of this function's copy
        key = (number, min_words, min_letters, edits)
        index = None
        for x in batches:
            if not x.num_rows:
                continue
            if key not in held:
                while len(held) > 1:
                    held.popitem(last=False)
                held[key] = build_index(sent.value, min_words, min_letters, edits)
            index = held[key]
            if index is None:
                continue
            got = sorted(find(index, x.column(1).to_pylist()))
            ids = [index.ids[k] for _, k in got]
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array([i for i, _ in got], pa.int32())), pa.array(ids, _arrow(kinds[1]))], names=["d_", "item_"])

    return d.mapInArrow(run, f"d_ {kinds[0]}, item_ {kinds[1]}")


def shortest_passages(items: DataFrame, kind: str, min_words: int, min_letters: int) -> DataFrame:
    """(item_, t_, b_, least_): the items long enough for a passage, with the letters of their shortest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            least = [measure(t, by, min_words, min_letters)[2] for t, by in zip(x.column(1).to_pylist(), x.column(2).to_pylist())]
            told = x.append_column("least_", pa.array(least, pa.int32()))
            yield told.filter(pa.array([v > 0 for v in least]))

    return items.mapInArrow(run, f"item_ {kind}, t_ string, b_ boolean, least_ int")


def _grams(df: DataFrame, id_: str, kind: str, q: int, keep: object = None) -> DataFrame:
    """(id, h, pos): the q-grams of the texts; with ``keep``, a broadcast filter, only those that may be in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for k, t in enumerate(x.column(1).to_pylist()):
                h = gram_hashes(letters(words(t)), q) if t else np.empty(0, np.uint64)
                pos = np.arange(len(h), dtype=np.int32)
                if keep is not None and len(h):
                    pos = pos[_may_hold(keep.value, h)]
                for at in range(0, len(pos), LETTERS_AT_ONCE):
                    p = pos[at : at + LETTERS_AT_ONCE]
                    yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(np.full(len(p), k, np.int32))), pa.array(h[p].view(np.int64)), pa.array(p)], names=["id_", "h", "pos"])

    return df.select(F.col(id_).alias("id_"), "t_").mapInArrow(run, f"id_ {kind}, h long, pos int")


def _may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    b = h >> np.uint64(64 - FILTER_BITS)
    return (bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1


def _filter_of(grams: DataFrame) -> np.ndarray:
    """One bit for each leading part of the grams' hashes: at most 2**21 words of 64 bits, or'ed in the map tasks."""
    top = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 as int))")
    t = grams.select(F.shiftright(top, 6).cast("int").alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[t.column("w").to_numpy()] = t.column("b").to_numpy().view(np.uint64)
    return out


def _join(d: DataFrame, items: DataFrame, kinds: tuple[str, str], min_words: int, min_letters: int, edits: int) -> DataFrame:
    """The same leaks by a join on q-grams; one length of gram for all items."""
    spark = d.sparkSession
    fit = materialize(shortest_passages(items, kinds[1], min_words, min_letters), "items")
    least = fit.agg(F.min("least_")).first()[0]
    if least is None:
        return spark.createDataFrame([], f"d_ {kinds[0]}, item_ {kinds[1]}")
    q = max(1, min(Q, least // (edits + 1)))
    mine = materialize(_grams(fit, "item_", kinds[1], q), "item-grams")
    sent = spark.sparkContext.broadcast(_filter_of(mine))
    theirs = _grams(d.where("t_ is not null"), "d_", kinds[0], q, sent)
    hit = theirs.select(F.col("id_").alias("d_"), "h", F.col("pos").alias("p_")).join(mine.select(F.col("id_").alias("item_"), "h", "pos"), "h")
    w = edits + 1
    diag = F.col("p_") - F.col("pos")
    band = F.floor(diag / w).cast("int")
    # a hit counts in both bands that hold its diagonal
    bands = F.array(band) if not edits else F.when(F.pmod(diag, F.lit(w)) < edits, F.array(band, band - 1)).otherwise(F.array(band))
    counted = hit.select("d_", "item_", F.explode(bands).alias("band_")).groupBy("d_", "item_", "band_").agg(F.count(F.lit(1)).alias("n_"))
    bound = F.greatest(F.lit(1), F.col("least_") - q + 1 - edits * q)
    size = fit.select(F.col("item_").alias("ii_"), "least_")
    regions = counted.join(size, counted["item_"].eqNullSafe(size["ii_"])).where(F.col("n_") >= bound).select("d_", "item_", "band_").distinct()
    regions = materialize(regions, "regions")
    left, right = d.select(F.col("d_").alias("dd_"), F.col("t_").alias("dt_")), fit.select(F.col("item_").alias("ii_"), F.col("t_").alias("it_"), "b_")
    both = regions.join(left, regions["d_"].eqNullSafe(left["dd_"])).join(right, regions["item_"].eqNullSafe(right["ii_"])).select("d_", "item_", "band_", "dt_", "it_", "b_")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)  # neighbouring regions often share their document
        none = np.empty(0, np.int64)
        for x in batches:
            good = []
            for b, dt, it, by in zip(*(x.column(i).to_pylist() for i in (2, 3, 4, 5))):
                if last[0] != dt:
                    ws = words(dt)
                    begins = np.zeros(sum(map(len, ws)) + 1, bool)
                    begins[starts(ws)] = True
                    last = (dt, (letters(ws), begins))
                a, begins = last[1]
                own, at, short = measure(it, by, min_words, min_letters)
                one = Index(q, edits, [0], [letters(own)], [at], np.array([0 if by else min_words]), np.array([short]), none, none, none, none, none)
                good.append(_near(one, 0, a, b * w) if edits else _exact(one, 0, a, begins, b))
            yield x.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(verify, f"d_ {kinds[0]}, item_ {kinds[1]}").distinct()


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
