"""SentencePiece encoding and decoding: pieces are found through a suffix array of the batch, then edges are relaxed."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import documents, ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of new units that are indexed at once; units whose ids a task keeps; longest unit relaxed with others.
INDEXED, KEPT, LONG = 1 << 20, 200_000, 256
#: A stretch that repeats up to PERIOD characters is shortened to about RUN characters if it has four times as many; it is
#: tried with AROUND characters beside it.
RUN, PERIOD, AROUND = 1 << 16, 64, 4096
#: Bytes of text that a task holds at a time.
SLICE = 4 << 20
_NONE = 1 << 40


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model; small and the same in every task."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    first_byte: int
    unknown: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in ids]
        found = cls([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], [not x for x in special], model.piece_to_id("<0x00>"), model.unk_id())
        if any(SPACE in p.lstrip(SPACE) for p, x in zip(found.pieces, found.normal, strict=True) if x):
            raise ValueError("pieces that go on after a space aren't supported")
        if not model.is_byte(found.first_byte):
            raise ValueError("a model with byte fallback is needed")
        return found


class Encoder:
    """Encodes batches of text; units (a run of spaces with the word after it) that came before are looked up.

    No piece reaches over the end of a unit, so units are encoded alone. New ones are concatenated and indexed by a
    suffix array over their first characters, as many as the longest piece has. Each piece is looked up by binary
    search for the range of suffixes that begin with it; each occurrence is an edge from its start over its length,
    and edges are put in order of their start. Relaxing joins, in each unit, the best-scored edge over two neighbouring
    symbols (the leftmost of equals) until none is left, which is the order in which byte-pair models merge.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        normal = [(i, p) for i, p in enumerate(vocabulary.pieces) if vocabulary.normal[i]]
        chars = sorted({ord(c) for _, p in normal for c in p})
        if len(chars) > 65000:
            raise ValueError("too many different characters")
        self.code = np.full(0x110000, len(chars) + 1, np.uint16)  # characters of no piece share one code
        self.code[chars] = np.arange(1, len(chars) + 1)
        self.longest = max(len(p) for _, p in normal)
        self.words = -(-self.longest // 4)
        self.size = np.array([len(p) for _, p in normal])
        self.ids = np.array([i for i, _ in normal])
        low = np.zeros((len(normal), self.words * 4), np.uint64)
        for r, (_, p) in enumerate(normal):
            low[r, : len(p)] = self.code[[ord(c) for c in p]]
        high = np.where(np.arange(self.words * 4) < self.size[:, None], low, np.uint64(65535))
        self.low, self.high = self._packed(low), self._packed(high)
        order = sorted(set(vocabulary.scores), reverse=True)
        place = {s: k for k, s in enumerate(order)}
        self.priority = np.array([place[s] for s in vocabulary.scores] + [_NONE])
        joins = "" if any("\n" in p for _, p in normal) else "\n"
        self.units = re.compile(rf"{joins}| *[^ {joins}]+| +" if joins else r" *[^ ]+| +")
        self.width = np.zeros(len(vocabulary.pieces), np.int64)
        self.width[self.ids] = self.size
        lead = [b for b in range(256) if b & 0xC0 != 0x80]  # a spelled character counts at its first byte
        self.width[vocabulary.first_byte + np.array(lead)] = 1
        self.kept: dict[str, bytes] = {}
        self.kind = np.uint16 if len(vocabulary.pieces) < 65536 else np.uint32

    @staticmethod
    def _packed(codes: np.ndarray) -> np.ndarray:
        c = codes.reshape(len(codes), -1, 4)
        return (c[:, :, 0] << np.uint64(48)) | (c[:, :, 1] << np.uint64(32)) | (c[:, :, 2] << np.uint64(16)) | c[:, :, 3]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        lists = [self.units.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.kept) > KEPT:
            self.kept = {}
        whole = {u: self._long(u) for x in lists for u in x if len(u) > INDEXED}
        new = list({u for x in lists for u in x if u not in self.kept and u not in whole})
        begin = 0
        while begin < len(new):
            end, held = begin, 0
            while end < len(new) and (end == begin or held + len(new[end]) < INDEXED):
                held += len(new[end])
                end += 1
            self.kept.update(zip(new[begin:end], self._encode(new[begin:end]), strict=True))
            begin = end
        get = self.kept.__getitem__
        if whole:
            return [np.frombuffer(b"".join(whole[u] if u in whole else get(u) for u in x), self.kind) for x in lists]
        return [np.frombuffer(b"".join(map(get, x)), self.kind) for x in lists]

    def _long(self, unit: str) -> bytes:
        """A unit longer than what is indexed at once: repeats shortened, then a window at a time.

        What a stretch of repeats becomes repeats too, but for its ends. So the stretch is shortened by whole cycles of its ids,
        and those are put back in its middle. A cycle is only trusted if the ids of the shortened stretch and of one that
        is a cycle longer, both with what stands beside them, differ by just that cycle.
        """
        short, cuts = self._shortened(unit)
        ids = np.frombuffer(self._windows(short), self.kind)
        ends, parts, at = np.cumsum(self.width[ids]), [], 0
        for middle, chars, times in cuts:
            k = int(np.searchsorted(ends, middle)) + 1
            last = k + int(np.searchsorted(ends[k:], ends[k - 1] + chars)) + 1
            if ends[last - 1] - ends[k - 1] != chars or not np.array_equal(ids[k:last], ids[last : 2 * last - k]):
                return self._windows(unit)
            parts += [ids[at:k], np.tile(ids[k:last], times)]
            at = k
        return np.concatenate([*parts, ids[at:]]).tobytes()

    def _shortened(self, unit: str) -> tuple[str, list[tuple[int, int, int]]]:
        """The unit with long repeats shortened, and for each the middle of what is left, the cycle's characters and how
        many cycles are gone."""
        points = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)
        at, kept, begin, held, cuts, probe = 0, [], 0, 0, [], min(AROUND, RUN)
        while at + probe <= len(points):
            piece = points[at : at + probe]
            p = next((p for p in range(1, min(PERIOD, probe // 4) + 1) if (piece[p:] == piece[:-p]).all()), None)
            if p is None:
                at += probe
                continue
            odd = np.flatnonzero(points[begin : len(points) - p] != points[begin + p :]) + begin
            start = int(odd[odd < at][-1]) + 1 if (odd < at).any() else begin
            end = int(odd[odd >= at][0]) + p if (odd >= at).any() else len(points)
            if end - start >= 4 * RUN and (chars := self._cycle(unit, start, end)):
                times = (end - start - RUN) // chars
                left = end - start - times * chars
                kept.append(unit[begin : start + left])
                cuts.append((held + start - begin + left // 2, chars, times))
                held += start + left - begin
                begin = end
            at = end
        return "".join([*kept, unit[begin:]]), cuts

    def _cycle(self, unit: str, start: int, end: int) -> int:
        """How many characters the ids' cycle in unit[start:end] has, 0 if no cycle can be trusted."""
        ids = np.frombuffer(self._encode([unit[start : start + RUN]])[0], self.kind)
        middle = ids[len(ids) // 4 : len(ids) // 4 * 3]
        t = next((t for t in range(1, len(middle) // 2) if np.array_equal(middle[t:], middle[:-t])), 0)
        chars = int(self.width[middle[:t]].sum())
        if not t or not chars or 2 * chars > RUN // 4:
            return 0
        left = end - start - (end - start - RUN) // chars * chars
        before, after = unit[max(0, start - AROUND) : start], unit[end : end + AROUND]
        a, b = (np.frombuffer(x, self.kind) for x in self._encode([before + unit[start : start + n] + after for n in (left, left + chars)]))
        k = int(np.searchsorted(np.cumsum(self.width[a]), len(before) + left // 2)) + 1
        return chars if np.array_equal(b, np.concatenate((a[: k + t], a[k:]))) else 0

    def _windows(self, unit: str) -> bytes:
        """A unit a window at a time.

        No symbol ever reaches over a place that no piece of two or more characters covers, so what lies between
        such places is encoded alone. Where a window has none, as may be in repeats that weren't shortened, it is doubled.
        """
        out, begin, size = [], 0, INDEXED
        while begin < len(unit):
            end = min(len(unit), begin + size)
            free = self._free(unit[begin : end + self.longest])
            free = [p for p in free.tolist() if begin + p < end] + [end - begin] * (end == len(unit))
            if not free:
                size *= 2
                continue
            out += self._encode([unit[begin + a : begin + b] for a, b in zip([0, *free], free, strict=False)])
            begin, size = begin + free[-1], INDEXED
        return b"".join(out)

    def _free(self, text: str) -> np.ndarray:
        """The places within the text that no piece of two or more characters covers."""
        code = self.code[np.frombuffer(text.replace(" ", SPACE).encode("utf-32-le"), np.uint32)]
        edges = self._edges(code, len(code) - np.arange(len(code))).reshape(len(code), -1)
        start, length = np.nonzero(edges[:, 2:] >= 0)
        over = np.zeros(len(code) + self.longest + 2, np.int64)
        np.add.at(over, start + 1, 1)
        np.add.at(over, start + length + 2, -1)
        return np.flatnonzero(np.cumsum(over)[: len(code)] == 0)[1:]

    def _encode(self, units: list[str]) -> list[bytes]:
        text = "\0".join(units).replace(" ", SPACE) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = np.array([len(u) for u in units])
        start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        code = self.code[points]
        ends = start + size
        code[ends] = 0
        edges = self._edges(code, np.repeat(ends, size + 1) - np.arange(len(code)))
        begin, length = self._relax(edges, start, size)
        ids = edges[begin * (self.longest + 1) + length]
        single = np.flatnonzero(ids < 0)  # characters of no piece: their bytes
        spelled = [list(chr(c).encode("utf-8", "surrogatepass")) for c in points[begin[single]].tolist()]
        times = np.ones(len(ids), np.int64)
        times[single] = [len(x) for x in spelled]
        at = np.concatenate(([0], np.cumsum(times)))
        flat = np.repeat(ids, times)
        if len(single):
            flat[np.concatenate([np.arange(at[i], at[i] + times[i]) for i in single])] = self.v.first_byte + np.concatenate(spelled)
        cut = at[np.searchsorted(begin, np.append(start, len(code)))] * np.dtype(self.kind).itemsize
        raw = flat.astype(self.kind).tobytes()
        return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _edges(self, code: np.ndarray, left: np.ndarray) -> np.ndarray:
        """For each start and each number of characters, the piece there, or -1."""
        n = len(code)
        padded = np.concatenate((code, np.zeros(4 * self.words + 4, np.uint16))).astype(np.uint64)
        room = np.concatenate((left, np.zeros(4 * self.words + 4, np.int64)))
        word = np.zeros(n + 4 * self.words, np.uint64)
        for j in range(4):
            word = (word << np.uint64(16)) | np.where(room[: len(word)] > j, padded[j : j + len(word)], np.uint64(0))
        at = lambda i, j: np.where(left[i] > 4 * j, word[i + 4 * j], np.uint64(0))
        # The suffix array: by four characters at a time, each round only where suffixes are still equal and go on.
        suffixes = np.argsort(word[:n], kind="stable")
        key = word[suffixes]
        group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        for j in range(1, self.words):
            many = np.bincount(group)[group] > 1
            open_ = np.flatnonzero(many & (left[suffixes] >= 4 * j))
            if not len(open_):
                break
            # Where suffixes ended earlier, a zero within the part that they share ended all of them.
            part, key = group[open_], at(suffixes[open_], j)
            order = np.lexsort((key, part))
            suffixes[open_] = suffixes[open_][order]
            split = np.zeros(n, bool)
            key = key[order]
            split[open_[1:]] = (part[1:] == part[:-1]) & (key[1:] != key[:-1])
            group = group + np.cumsum(split)
        first, last = (self._search(x, suffixes, at, right) for x, right in ((self.low, False), (self.high, True)))
        found = np.maximum(last - first, 0)
        rows = np.repeat(first - np.concatenate(([0], np.cumsum(found)[:-1])), found) + np.arange(found.sum())
        edges = np.full(n * (self.longest + 1), -1, np.int32)  # sorted by start, then length: one place for each
        edges[suffixes[rows] * (self.longest + 1) + np.repeat(self.size, found)] = np.repeat(self.ids, found)
        return edges

    def _search(self, key: np.ndarray, suffixes: np.ndarray, at, right: bool) -> np.ndarray:
        """For each key, how many suffixes are smaller (right: or equal)."""
        low, high = np.zeros(len(key), np.int64), np.full(len(key), len(suffixes))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            up, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for j in range(self.words):
                w, k = at(suffixes[mid], j), key[open_, j]
                up |= same & (w < k)
                same &= w == k
            up |= same & right
            low[open_[up]] = mid[up] + 1
            high[open_[~up]] = mid[~up]
        return low

    def _relax(self, edges: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left: start and length, in order."""
        wide = self.longest + 1
        done_at, done_len = [], []
        for u in np.flatnonzero(size > LONG).tolist():
            a, b = self._relax_one(edges, int(start[u]), int(size[u]))
            done_at.append(a)
            done_len.append(b)
        short = size <= LONG
        count = size[short]
        unit = np.repeat(np.arange(len(count)), count)
        first = np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else count
        at = np.repeat(start[short] - first, count) + np.arange(count.sum())
        length = np.ones(len(at), np.int64)
        while len(at):
            both = length[:-1] + length[1:]
            pair = (unit[1:] == unit[:-1]) & (both < wide)
            best = np.full(len(at), _NONE)
            k = np.flatnonzero(pair)
            best[k] = self.priority[edges[at[k] * wide + both[k]]]
            heads = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            runs = np.diff(np.append(heads, len(at)))
            least = np.minimum.reduceat(best, heads)
            hit = np.flatnonzero((best == np.repeat(least, runs)) & (best < _NONE))
            hit = hit[np.concatenate(([True], unit[hit[1:]] != unit[hit[:-1]]))] if len(hit) else hit  # the leftmost
            length[hit] += length[hit + 1]
            keep = np.repeat(least < _NONE, runs)
            done_at.append(at[~keep])
            done_len.append(length[~keep])
            keep[hit + 1] = False
            at, length, unit = at[keep], length[keep], unit[keep]
        a, b = np.concatenate([np.zeros(0, np.int64), *done_at]), np.concatenate([np.zeros(0, np.int64), *done_len])
        order = np.argsort(a)
        return a[order], b[order]

    def _relax_one(self, edges: np.ndarray, start: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long unit, with a queue."""
        wide, length = self.longest + 1, [1] * size
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        queue: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < size and (both := length[i] + length[j]) < wide:
                p = int(self.priority[edges[(start + i) * wide + both]])
                if p < _NONE:
                    heapq.heappush(queue, (p, i, both))

        for i in range(size - 1):
            offer(i)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i]
            if not length[i] or j >= size or length[i] + length[j] != both:
                continue
            length[i], length[j], after[i] = both, 0, after[j]
            if after[j] < size:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        left = np.flatnonzero(np.array(length))
        return start + left, np.array(length)[left]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        raw = [p.replace(SPACE, " ").encode() if x else b"" for p, x in zip(v.pieces, v.normal, strict=True)]
        raw[v.first_byte : v.first_byte + 256] = [bytes([b]) for b in range(256)]
        raw[v.unknown] = " ⁇ ".encode()
        self.raw, self.spaced = raw, [x and p.startswith(SPACE) for p, x in zip(v.pieces, v.normal, strict=True)]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.raw.__getitem__, ids))
        if ids and self.spaced[ids[0]]:
            data = data[1:]
        return data.decode("utf-8", "replace")


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    first, held, size = 0, [], 0
    for i, x in enumerate(batch.column(column)):
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size > SLICE:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (the pieces of the whole text) and exact (whether decoding gives the text back).

    The model's file is read on the driver; tasks get its pieces. Ids equal those of the SentencePiece library. A text
    with U+2581 itself isn't exact, as the model writes spaces that way. Null and empty texts have no ids. A very long
    text is held whole, but a long run without spaces is indexed a window at a time. Each row is
    encoded alone, without a shuffle: repeated rows get equal ids, null ids of rows pass through, an empty table gives
    an empty result. Other columns are ignored.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for batch in batches:
            for first, texts in _texts(batch, "text"):
                ids = encoder.encode(texts)
                exact = [decoder.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), flat, pa.array(exact)], names=["doc_id", "ids", "exact"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, exact boolean")


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; null and empty ids give an empty text, ids of control pieces nothing."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            texts = [decoder.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op10_suffix_array_pieces(spark, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")
