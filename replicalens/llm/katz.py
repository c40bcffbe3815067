"""LM scoring: a Katz back-off model over words of any order, counted, normalised and evaluated on the executors.

Model. Tokens are the lower-cased words of a text and one end; before the first stand as many starts as a history needs.
A word that training lacks is the one class "unknown". p(w) = d(c) c / N, the unknown class gets what discounts leave.
For a history h, p(w | h) = d(c) c / c(h) where h w was seen c times in training, else bow(h) p(w | h'), h' being h without
its first word; where training lacks h itself, p(w | h) = p(w | h'). bow(h) is what the seen ones leave, divided by 1 - the
sum of p(. | h') over them: both sums run over all continuations, so each history's probabilities add up to 1. d(c) are
the Good-Turing discounts of the n-gram's order for c <= K, (c - 1/2) / c where those fall outside (0, 1), and 1 above K.
Where discounts leave nothing (no continuation has c <= K), c(h) + 1 takes the place of c(h).

Steps. Texts become blocks of word codes, files below the shared folder. Each block sends its distinct words to buckets by
hash; a bucket counts them, numbers them by frequency, keeps its part of the unigram table and answers each block with
numbers and counts. Then, for each order from 2 on, each block sends its distinct n-grams whose history training has seen,
with their training counts, sorted and packed, to buckets by history; histories that are equal but for their first word go
together, unless these are too many. A bucket merges them, part by part, into its share of that order's table and answers
each block, n-gram by n-gram, with the counts, and with the sums that the back-off weights of its unseen ones need. Once
the counts of counts of an order are known, a block evaluates its tokens recursively. What travels is one entry for each
block and distinct n-gram, not for each document. A history above the hot limit is dealt by n-gram, so that no bucket gets
all of it; its sums meet on the driver, at most 1 / HOT_SHARE of them an order, and follow the same formulas. The tables,
partitioned by bucket, stay below the shared folder; ``tables`` of the result names them by order.

Defined cases: a null text is empty: its one token is the end; without training documents every token is unknown, with
probability 1; a null doc_id is training; repeated rows count and are scored each; an empty table gives an empty result;
words of any length and texts of any number of words are taken whole; other columns of the table are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K, ORDER = 5, 3
HOT_SHARE, HOT_LEAST, WIDE = 1 / 16384, 1000, 1 << 14
#: Text of a block and of a bucket; a bucket is merged in PARTS, one after the other, so that its memory is that of one.
BLOCK_BYTES, BUCKET_BYTES, PARTS = 8 << 20, 10 << 20, 1
UNKNOWN, START, END, FIRST = 0, 1, 2, 3
MIX = np.uint64(0x9E3779B97F4A7C15)


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0) .. d(K + 1) from the counts of counts n[1] .. n[K + 1]; d(0) is unused, d(K + 1) = 1 stands for all above."""
    d = np.ones(K + 2)
    for r in range(1, K + 1):
        d[r] = (r - 0.5) / r
        if n[1] and n[r]:
            tail = (K + 1) * n[K + 1] / n[1]
            good = (r + 1) * n[r + 1] / n[r]
            if tail < 1 and 0 < (value := (good / r - tail) / (1 - tail)) < 1:
                d[r] = value
    return d


@dataclass(frozen=True)
class Unigrams:
    """What a count needs to become a probability."""

    tokens: int
    kinds: int
    d: np.ndarray
    unknown: float
    more: int  # 1 where discounts leave nothing

    @staticmethod
    def of(tokens: int, kinds: int, n: np.ndarray) -> Unigrams:
        d = discounts(n)
        r = np.arange(K + 2)
        left = float((((1 - d) * r * n)[1 : K + 1]).sum())
        if not tokens or left <= 0:
            return Unigrams(tokens, kinds, d, 1 / (tokens + 1), 1)
        return Unigrams(tokens, kinds, d, left / tokens, 0)

    @property
    def below(self) -> int:
        return max(self.tokens + self.more, 1)

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.d[np.minimum(count, K + 1)] * count / self.below, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.kinds + 1))


def _raw(arrays: list[np.ndarray]) -> bytes:
    """Several arrays of whole numbers, each in its smallest type, or of doubles in one value; _arrays undoes it.

    Bytes of equal weight stand together, which packs better.
    """
    head, body = [], []
    for x in arrays:
        x = np.ascontiguousarray(x)
        if x.dtype.kind in "iu":
            low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
            x = x.astype(np.min_scalar_type(high) if low >= 0 else np.int64)
        head.append(f"{x.dtype.str},{len(x)}")
        body.append(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())
    names = ";".join(head).encode()
    return len(names).to_bytes(4, "little") + names + b"".join(body)


def _arrays(raw: bytes) -> list[np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for kind, size in (x.split(",") for x in raw[4:at].decode().split(";")):
        kind, size = np.dtype(kind), int(size)
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += size * kind.itemsize
    return out


def _join(arrays: list[np.ndarray]) -> bytes:
    import zstandard

    return zstandard.compress(_raw(arrays), 3)


def _split(data: bytes) -> list[np.ndarray]:
    import zstandard

    return _arrays(zstandard.decompress(data))


def _words(values: list) -> bytes:
    import zstandard

    return zstandard.compress(b"\n".join(x if isinstance(x, bytes) else x.encode("utf-8", "surrogatepass") for x in values), 3)


def _unwords(data: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.decompress(data)
    return raw.split(b"\n") if raw else []


ANSWERS = "block string, bucket int, level int, n long, kinds long, tokens long, counts_of_counts array<long>, table binary, answer binary, hot array<struct<history:array<long>,n:array<long>,p:double>>"
COLUMNS = [c.split()[0] for c in ANSWERS.split(", ")]


def _blocks(docs: DataFrame, root: str, buckets: int, block_bytes: int) -> DataFrame:
    """Writes the blocks' files; each block's distinct words by bucket, with their training counts."""

    def make(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, block in enumerate(common.blocks(batches, block_bytes)):
            codes, distinct, counts = common.words(common.column(block, "text"))
            held = common.column(block, "held_out").to_numpy(zero_copy_only=False).astype(bool)
            bucket = (common.text_hash(distinct) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")  # codes of a bucket's words follow each other
            new = np.empty(len(order), np.int64)
            new[order] = np.arange(len(order))
            codes, bucket = new[codes], bucket[order]
            trained = np.bincount(codes, np.repeat(~held, counts), len(order)).astype(np.int64)
            words = distinct.take(pa.array(order)).to_pylist()
            name = f"{part:06d}-{number:05d}"
            keys = common.column(block, "doc_id")
            common.write_file(f"{root}/blocks/{name}", _join([codes, counts, held, pc.fill_null(keys, 0).to_numpy(zero_copy_only=False).astype(np.int64), keys.is_null().to_numpy(zero_copy_only=False)]))
            limits = np.searchsorted(bucket, np.arange(buckets + 1))
            out = [(int(b), name, _words(words[limits[b] : limits[b + 1]]), common.packed(trained[limits[b] : limits[b + 1]])) for b in np.flatnonzero(np.diff(limits))]
            # A block without words still has documents: its row keeps it in the chain.
            out = out or [(0, name, _words([]), common.packed(trained))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "words", "counts"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(make, "bucket int, block string, words binary, counts binary")


def _classes(counts: np.ndarray) -> list[int]:
    """How many of the counts are 1, 2 .. K + 1."""
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2].tolist()


def _count_words(buckets: int):
    def count(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iloc[0])
        lists = [_unwords(x) for x in frame["words"]]
        size = [len(x) for x in lists]
        coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.concatenate([common.unpacked(x, np.int64) for x in frame["counts"]]) if len(frame) else np.zeros(0, np.int64)
        total = np.bincount(code, counts, len(coded.dictionary)).astype(np.int64)
        order = np.lexsort((np.arange(len(total)), -total))
        rank = np.empty(len(total), np.int64)
        rank[order] = np.arange(len(total))
        number = np.where(total > 0, FIRST + rank * buckets + bucket, UNKNOWN)
        seen = order[total[order] > 0]
        dictionary = coded.dictionary.to_pylist()
        words = np.frombuffer(_words([dictionary[i] for i in seen]), np.uint8)
        out = [(None, bucket, 1, len(seen), len(seen), int(total.sum()), _classes(total[seen]), _join([words, number[seen], total[seen]]), None, [])]
        ends = np.cumsum(size)
        for block, a, b in zip(frame["block"], ends - size, ends, strict=True):
            mine = code[a:b]
            out.append((block, bucket, 1, b - a, 0, 0, [], None, _join([number[mine], total[mine]]), []))
        return pd.DataFrame(out, columns=COLUMNS)

    return count


@dataclass(frozen=True)
class Model:
    """What the driver knows of the orders counted so far; hot: for each order, the sums of its hot histories."""

    uni: Unigrams
    train_docs: int
    limit: int  # a history seen as often is hot
    wide: int  # a shorter history seen as often does not keep its histories together
    d: dict[int, np.ndarray]
    hot: dict[int, dict[tuple, tuple]]

    def p(self, level: int, count: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The probability of n-grams of an order that were seen, below: their history's count, with one more where asked for."""
        d = self.uni.d if level == 1 else self.d[level]
        return d[np.minimum(count, K + 1)] * count / np.maximum(below, 1)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the one before."""
    n = len(columns[0])
    head = np.zeros(n, bool)
    head[:1] = True
    for x in columns:
        head[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(head)


def _key(columns: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """One number for each row of columns (values, how many there can be) that sorts like them, the first before all."""
    key, room = columns[0][0].astype(np.int64), columns[0][1]
    for x, size in columns[1:]:
        if room * size >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1]
            room = len(key) + 1
        key, room = key * size + x, room * size
    return key


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row for each different key, in order, and the place of every row's key among them."""
    order = np.argsort(key)
    key = key[order]
    head = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=head[1:])
    at = np.empty(len(key), np.int32)
    at[order] = np.cumsum(head, dtype=np.int32) - np.int32(1)
    return order[head], at


class Entries:
    """A block's distinct n-grams of one order, by bucket, shorter history, first word and word."""

    def __init__(self, block: Block, level: int, model: Model, buckets: int):
        b, m = block, len(block.number)
        times = b.history_counts(level)
        on = np.flatnonzero(times > 0)
        times, word, words = times[on], b.word[on], [b.back(k)[on] for k in range(level - 1, 0, -1)]  # the history's words, first to last
        # Histories that are equal but for their first word go together, as long as there are not too many.
        code = np.zeros(len(on), np.uint64)
        for x in words[1:]:
            code = common.mix64(code * MIX + b.number[x].astype(np.uint64))
        wide = b.history_counts(level - 1)[on] >= model.wide if level > 2 else np.ones(len(on), bool)
        code[wide] = common.mix64(code[wide] * MIX + b.number[words[0][wide]].astype(np.uint64))
        hot = times >= model.limit
        code[hot] = common.mix64(code[hot] * MIX + b.number[word[hot]].astype(np.uint64))
        goes = (code % np.uint64(buckets * PARTS)).astype(np.int32)  # bucket and part
        row, at = _distinct(_key([(goes, buckets * PARTS), *((x, m) for x in (*words[1:], words[0], word))]))
        self.rep, self.times, self.hot, self.goes, self.words, self.word = on[row], times[row], hot[row], goes[row], [x[row] for x in words], word[row]
        self.at = np.full(len(b.word), -1, np.int32)
        self.at[on] = at
        # A history ends with its part: hot ones stand in several.
        self.heads = _runs(self.goes, *self.words)
        self.head_of = np.repeat(np.arange(len(self.heads)), np.diff(np.append(self.heads, len(self.rep))))


class Block:
    """A block's tokens, and what answers tell of their n-grams."""

    def __init__(self, root: str, frame: pd.DataFrame, model: Model):
        system, path = common.open_fs(f"{root}/blocks/{frame['block'].iloc[0]}")
        with system.open_input_file(path) as f:
            codes, self.counts, self.held, self.keys, self.no_key = _split(f.read())
        self.model, self.answers = model, frame.sort_values("bucket")
        numbers, times = zip(*(_split(x) for x in self.answers["answer"][self.answers["level"] == 1]), strict=True)
        number = np.concatenate([[UNKNOWN, START, END], *numbers]).astype(np.int64)
        times = np.concatenate([[0, model.train_docs, model.train_docs], *times]).astype(np.int64)
        # Codes follow the numbers, so that sorted n-grams have sorted numbers, which pack well.
        order = np.argsort(number[FIRST:], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        number[FIRST:], times[FIRST:] = number[FIRST:][order], times[FIRST:][order]
        codes = (place[codes] + FIRST).astype(np.int32)
        codes[number[codes] == UNKNOWN] = UNKNOWN  # unknown words are one
        self.number, self.times = number, times
        self.counts = self.counts.astype(np.int64)
        ends = np.cumsum(self.counts)
        self.word = np.insert(codes, ends, END)
        self.docs = len(self.counts)
        self.doc = np.repeat(np.arange(self.docs, dtype=np.int32), self.counts + 1)
        begins = ends - self.counts + np.arange(self.docs)
        self.place = np.arange(len(self.word), dtype=np.int32) - np.repeat(begins, self.counts + 1).astype(np.int32)
        #: By order: the place of each token's n-gram among the distinct ones (-1: its history is unseen), and their counts.
        self.at, self.seen = {1: self.word}, {1: times}
        self.below: dict[int, np.ndarray] = {}
        self.log = np.log10(model.uni.p(times))[self.word]

    def back(self, k: int) -> np.ndarray:
        """The word k places before each token."""
        out = np.full(len(self.word), START, np.int32)
        out[k:] = self.word[: len(self.word) - k]
        out[self.place < k] = START
        return out

    def history(self, level: int) -> np.ndarray:
        """The n-gram of one order less before each token, as its place; one behind all stands for starts alone."""
        starts = START if level == 2 else len(self.seen[level - 1])
        out = np.full(len(self.word), starts, np.int32)
        out[1:] = self.at[level - 1][:-1]
        out[self.place == 0] = starts
        return out

    def history_counts(self, level: int) -> np.ndarray:
        """How often training has seen the history of each token."""
        counts = np.concatenate([self.seen[level - 1], [self.model.train_docs, 0]])  # the last is -1: unseen
        return counts[self.history(level)]

    def entries(self, level: int, buckets: int) -> list[tuple]:
        """(bucket, packed n-grams) of an order."""
        e, model = Entries(self, level, self.model, buckets), self.model
        lower = self.at[level - 1][e.rep]  # training has seen the history, and so the shorter one too
        count = self.seen[level - 1][lower] if level > 2 else None
        below = self.below[level - 1][lower] if level > 2 else np.full(len(lower), model.uni.below)
        taken = (e.at >= 0) & ~self.held[self.doc]
        trained = np.bincount(e.at[taken], minlength=len(e.rep))
        starts, out = _runs(e.goes // PARTS), []
        place = np.zeros(len(self.number), np.int32)
        for low, high in zip(starts, [*starts[1:], len(e.goes)], strict=False):
            bucket = int(e.goes[low]) // PARTS
            limits = low + np.searchsorted(e.goes[low:high], bucket * PARTS + np.arange(PARTS + 1))
            # The words of a bucket's parts are told once.
            words = [x[low:high] for x in (*e.words, e.word)]
            if (high - low) * 4 < len(self.number):
                used = np.unique(np.concatenate(words))
            else:
                there = np.zeros(len(self.number), bool)
                for x in words:
                    there[x] = True
                used = np.flatnonzero(there)
            place[used] = np.arange(len(used))
            pieces = [_raw([np.diff(self.number[used], prepend=0), *([_turns(self.times[used])] if level == 2 else [])])]
            for part in range(PARTS):
                s = slice(limits[part], limits[part + 1])
                more = [below[s], count[s] if level > 2 else None, e.hot[s]]
                pieces.append(_packed([place[x[s]] for x in e.words], place[e.word[s]], trained[s], more) if s.stop > s.start else b"")
            out.append((bucket, _bundle(pieces)))
        return out

    def learn(self, level: int, buckets: int) -> None:
        """Takes in the answers to an order's entries."""
        e, d = Entries(self, level, self.model, buckets), self.model.d[level]
        mine = self.answers["answer"][self.answers["level"] == level]
        parts = [_arrays(x) for answer in mine for x in _unbundle(answer)]
        cat = lambda i: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0)
        count, flat = cat(0).astype(np.int64), cat(1).astype(bool)
        unseen = count == 0
        head_hot = e.hot[e.heads]
        need = np.zeros(len(e.heads), bool)
        need[e.head_of[unseen]] = True
        need &= ~head_hot
        classes, mass = np.zeros((len(e.heads), K), np.int64), np.zeros(len(e.heads))
        for r in range(K):
            classes[need, r] = cat(2 + r)
        mass[need] = cat(2 + K)
        hots = np.flatnonzero(head_hot)
        _, once, again = np.unique(self.history(level)[e.rep[e.heads[hots]]], return_index=True, return_inverse=True)
        if len(once):  # a hot history stands in many buckets
            found = [self.model.hot[level][tuple(int(self.number[x[i]]) for x in e.words)] for i in e.heads[hots[once]]]
            classes[hots], mass[hots] = np.stack([x[0] for x in found])[again], np.array([x[1] for x in found])[again]
            flat[hots] = ~classes[hots].any(1)
        times = e.times[e.heads]
        below = times + flat
        left = (classes * np.arange(1, K + 1) * (1 - d[1 : K + 1])).sum(1) + flat
        with np.errstate(divide="ignore", invalid="ignore"):
            bow = np.log10(left) - np.log10(below) - np.log10(1 - mass)
        value = np.where(unseen, bow[e.head_of] + self.log[e.rep], np.log10(np.maximum(self.model.p(level, count, below[e.head_of]), 1e-300)))
        on = e.at >= 0
        self.log = np.where(on, value[np.maximum(e.at, 0)] if len(value) else 0.0, self.log)
        self.at[level], self.seen[level], self.below[level] = e.at, count, below[e.head_of]

    def scores(self) -> pd.DataFrame:
        n = np.bincount(self.doc, minlength=self.docs)
        times, uni = self.times, self.model.uni
        sums = lambda x: np.bincount(self.doc, x, self.docs).astype(np.float64)
        out = pd.DataFrame({"doc_id": pd.array(self.keys, "Int64"), "held_out": self.held, "n_tokens": n, "n_known": sums(times[self.word] > 0).astype(np.int64), "train_tokens": uni.tokens, "base_score": sums(uni.base(times)[self.word]), "score": sums(self.log)})
        return out.assign(doc_id=lambda x: x["doc_id"].mask(self.no_key))


def _steps(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences of numbers that rise within segments, each of which begins with its own first; _risen undoes it."""
    out = np.diff(x, prepend=0)
    out[starts] = x[starts]
    return out


def _risen(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps.astype(np.int64))
    return (total - np.repeat(total[starts] - steps[starts].astype(np.int64), np.diff(np.append(starts, len(steps))))).astype(np.int32)


def _turns(x: np.ndarray) -> np.ndarray:
    """Differences of numbers that change little from one to the next, as whole numbers from 0 on; _turned undoes it."""
    step = np.diff(x.astype(np.int64), prepend=0)
    return (step << 1) ^ (step >> 63)


def _turned(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    return np.cumsum((x >> 1) ^ -(x & 1))


def _bundle(pieces: list[bytes]) -> bytes:
    """Several values of _raw as one that is compressed."""
    import zstandard

    return zstandard.compress(np.array([len(pieces), *map(len, pieces)], np.int64).tobytes() + b"".join(pieces), 3)


def _unbundle(data: bytes) -> list[bytes]:
    import zstandard

    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(data, np.int64, n, 8))
    return [data[a:b] for a, b in zip([8 * (n + 1), *ends[:-1]], ends, strict=True)]


def _packed(history: list[np.ndarray], word: np.ndarray, counts: np.ndarray, more: list[np.ndarray] | None = None) -> bytes:
    """Sorted n-grams: by groups of histories that are equal but for their first word.

    more: what a group and, beyond order 2, an n-gram need for the lower order's probability, and whether a history is hot.
    """
    shorter, first = history[1:], history[0]
    groups = _runs(*shorter) if shorter else np.zeros(1, np.int64)
    heads = _runs(*shorter, first) if shorter else _runs(first)
    groups_at = np.searchsorted(heads, groups)
    parts = [np.diff(x[groups], prepend=0) if k == 0 else x[groups] for k, x in enumerate(shorter)]
    arrays = [*parts, _steps(first[heads], groups_at), _steps(word, heads), np.diff(np.append(groups_at, len(heads))), np.diff(np.append(heads, len(word))), counts]
    if more:
        arrays += [_turns(more[0][groups]), *([more[1]] if shorter else []), more[2][heads]]
    return _raw(arrays)


class Unpacked:
    """What _packed made of n-grams of an order; words stand for the numbers in used."""

    def __init__(self, data: bytes, level: int, used: np.ndarray):
        rest = _arrays(data)
        self.shorter, (first, word, heads, size, self.counts, *more) = rest[: level - 2], rest[level - 2 :]
        if level > 2:
            self.shorter[0] = np.cumsum(self.shorter[0].astype(np.int64))
        heads, size, self.used = heads.astype(np.int64), size.astype(np.int64), used
        self.first, self.word = _risen(first, np.cumsum(heads) - heads), _risen(word, np.cumsum(size) - size)
        self.group_of = np.repeat(np.arange(len(heads), dtype=np.int32), heads)  # of each head
        self.head_of = np.repeat(np.arange(len(size), dtype=np.int32), size)  # of each n-gram
        if more:
            self.below, self.hot, self.lower = _turned(more[0]), more[-1].astype(bool), more[1] if level > 2 else None


def ngrams(table: bytes, level: int) -> list[tuple[tuple, int]]:
    """(numbers of its words, count) of each n-gram of a part's table."""
    numbers, packed = _unbundle(table)
    u = Unpacked(packed, level, np.cumsum(_arrays(numbers)[0].astype(np.int64)))
    group = u.group_of[u.head_of]
    columns = [u.used[u.first][u.head_of], *(u.used[x][group] for x in u.shorter), u.used[u.word]]
    return [(tuple(int(x) for x in g), int(c)) for *g, c in zip(*columns, u.counts, strict=True)]


def _same(parts: list[np.ndarray], dense: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of keys (dense[i] x size + parts[i]) of all parts: a row of each different one, and each key's number."""
    return _distinct(np.concatenate([d.astype(np.int64) * size + x for d, x in zip(dense, parts, strict=True)]))


def _cut(values: np.ndarray, parts: list) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(x) for x in parts])[:-1])


def _merge(level: int, model: Model):
    """One bucket: its share of an order's table, and its answers to the blocks."""

    def part_of(parts: list[Unpacked], counts: list[np.ndarray] | None) -> tuple[list[bytes], tuple]:
        """The answers to those who sent the n-grams, and (n, counts of counts, table, hot histories)."""
        every, at = np.unique(np.concatenate([p.used for p in parts]), return_inverse=True)
        local = _cut(at.astype(np.int32), [p.used for p in parts])
        kinds = len(every)
        # Numbers for equal shorter histories, histories and n-grams in turn; each rises with the words.
        group = [np.zeros(len(p.below), np.int32) for p in parts]
        for k in range(level - 2):
            group = _cut(_same([u[p.shorter[k]] for u, p in zip(local, parts, strict=True)], group, kinds)[1], group)
        first_head, heads = _same([u[p.first] for u, p in zip(local, parts, strict=True)], [g[p.group_of] for g, p in zip(group, parts, strict=True)], kinds)
        head = _cut(heads, [p.first for p in parts])
        first, pair = _same([u[p.word] for u, p in zip(local, parts, strict=True)], [h[p.head_of] for h, p in zip(head, parts, strict=True)], kinds)
        cat = lambda get: np.concatenate([get(p) for p in parts])
        count = np.bincount(pair, cat(lambda p: p.counts.astype(np.int64)), len(first)).astype(np.int64)
        of = np.concatenate([h[p.head_of] for h, p in zip(head, parts, strict=True)])[first]  # each n-gram's history
        lower = np.concatenate([p.lower if level > 2 else c[p.word] for p, c in zip(parts, counts or parts, strict=True)])[first]
        below, hot = cat(lambda p: p.below[p.group_of][p.head_of])[first], cat(lambda p: p.hot)[first_head]
        seen, n = count > 0, len(first_head)
        few = seen & (count <= K)
        classes = np.bincount(of[few].astype(np.int64) * K + count[few] - 1, minlength=n * K).reshape(n, K).astype(np.int32)
        mass = np.bincount(of[seen], model.p(level - 1, lower[seen].astype(np.int64), below[seen]), n).astype(np.float64)
        flat = ~classes.any(1) & ~hot
        answers = []
        for p, h, mine in zip(parts, head, _cut(pair, [p.word for p in parts]), strict=True):
            c = count[mine]
            need = np.zeros(len(h), bool)
            need[p.head_of[c == 0]] = True
            need = h[need & ~hot[h]]
            answers.append(_raw([c, flat[h], *classes[need].T, mass[need]]))
        # The words of each history, for the table and for what meets on the driver.
        words = [np.concatenate([u[p.first] for u, p in zip(local, parts, strict=True)])[first_head], *(np.concatenate([u[p.shorter[k]][p.group_of] for u, p in zip(local, parts, strict=True)])[first_head] for k in range(level - 2))]
        hots = [{"history": [int(every[x[i]]) for x in words], "n": classes[i].tolist(), "p": float(mass[i])} for i in np.flatnonzero(hot)]
        kept = np.flatnonzero(seen)
        word = np.concatenate([u[p.word] for u, p in zip(local, parts, strict=True)])[first]
        table = _bundle([_raw([np.diff(every, prepend=0)]), _packed([x[of[kept]] for x in words], word[kept], count[kept])]) if len(kept) else None
        return answers, (len(kept), _classes(count[seen]), table, hots)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iloc[0])
        pieces = [_unbundle(x) for x in frame["entries"]]
        words = [_arrays(x[0]) for x in pieces]
        used = [np.cumsum(x[0].astype(np.int64)) for x in words]
        answers, out = [[] for _ in pieces], []
        for part in range(1, PARTS + 1):
            here = [i for i, x in enumerate(pieces) if x[part]]
            if here:
                found, (n, of, table, hots) = part_of([Unpacked(pieces[i][part], level, used[i]) for i in here], [_turned(words[i][1]) for i in here] if level == 2 else None)
                for i, x in zip(here, found, strict=True):
                    answers[i].append(x)
                out.append((None, bucket, level, n, 0, 0, of, table, None, hots))
        out += [(block, bucket, level, 0, 0, 0, [], None, _bundle(x), []) for block, x in zip(frame["block"], answers, strict=True)]
        return pd.DataFrame(out, columns=COLUMNS)

    return merge


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _evaluated(root: str, frame: pd.DataFrame, model: Model, buckets: int, level: int) -> Block:
    """A block that knows all orders below ``level``."""
    block = Block(root, frame, model)
    for n in range(2, level):
        block.learn(n, buckets)
    return block


def _send(root: str, shared, buckets: int, level: int):
    def send(frame: pd.DataFrame) -> pd.DataFrame:
        out = _evaluated(root, frame, shared.value, buckets, level).entries(level, buckets)
        return pd.DataFrame([(frame["block"].iloc[0], *x) for x in out], columns=["block", "bucket", "entries"])

    return send


@dataclass
class Result:
    scores: DataFrame
    tables: dict[int, str]
    tokens: int
    kinds: int


def train_and_score(docs: DataFrame, order: int = ORDER, bucket_bytes: int = BUCKET_BYTES, hot_least: int = HOT_LEAST, block_bytes: int = BLOCK_BYTES, wide: int = WIDE) -> Result:
    """Learns from the rows of docs(doc_id, text, held_out) that are not held out; scores all."""
    spark = docs.sparkSession
    common.small_batches(spark)
    root = common.new_folder(spark, "katz")
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count_if(~F.col("held_out")).alias("d")).first()
    buckets, train_docs = int(max(4, -(-(size["b"] or 0) // bucket_bytes))), size["d"]
    tables = {n: f"{root}/order{n}" for n in range(1, order + 1)}
    rows = common.stage(_blocks(docs, root, buckets, block_bytes).groupBy("bucket").applyInPandas(_count_words(buckets), ANSWERS), tables[1])
    classes = lambda t: [F.coalesce(F.sum(F.element_at("counts_of_counts", r)), F.lit(0)).alias(f"n{r}") for r in range(1, K + 2)]
    sums = rows.where("block IS NULL").agg(F.sum("kinds").alias("kinds"), F.sum("tokens").alias("tokens"), *classes(rows)).first()
    n = np.array([0, *(sums[f"n{r}"] for r in range(1, K + 2))], np.int64)
    if 0 < train_docs <= K + 1:
        n[train_docs] += 1  # the end
    tokens, kinds = (sums["tokens"] or 0) + train_docs, (sums["kinds"] or 0) + (train_docs > 0)
    model = Model(Unigrams.of(tokens, kinds, n), train_docs, max(hot_least, int(tokens * HOT_SHARE) + 1), wide, {}, {})
    answers = rows.where("block IS NOT NULL").select("block", "bucket", "level", "answer")
    for level in range(2, order + 1):
        shared = spark.sparkContext.broadcast(model)  # discounts, and at most 1 / HOT_SHARE histories an order
        entries = answers.groupBy("block").applyInPandas(_send(root, shared, buckets, level), "block string, bucket int, entries binary")
        rows = common.stage(entries.groupBy("bucket").applyInPandas(_merge(level, model), ANSWERS), tables[level])
        of = rows.where("block IS NULL").agg(*classes(rows)).first()
        hots = rows.where("block IS NULL").select(F.explode("hot").alias("x")).select("x.*")
        hots = hots.groupBy("history").agg(F.array(*[F.sum(F.element_at("n", r + 1)) for r in range(K)]).alias("n"), F.sum("p").alias("p")).collect()
        found = {tuple(r["history"]): (np.array(r["n"], np.int64), r["p"]) for r in hots}
        d = discounts(np.array([0, *(of[f"n{r}"] for r in range(1, K + 2))], np.int64))
        model = Model(model.uni, train_docs, model.limit, model.wide, {**model.d, level: d}, {**model.hot, level: found})
        answers = answers.unionByName(rows.where("block IS NOT NULL").select("block", "bucket", "level", "answer"))
    last = spark.sparkContext.broadcast(model)

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        return _evaluated(root, frame, last.value, buckets, order + 1).scores()

    return Result(answers.groupBy("block").applyInPandas(finish, SCORES), tables, tokens, kinds)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = common.in_order(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)))
    return train_and_score(docs).scores
