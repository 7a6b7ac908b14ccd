"""SentencePiece encoding and decoding with n-best segmentation.

A text's lattice has an edge for every piece that spells a stretch of it, scored as the
model scores the piece; a character that no piece spells is an edge of its own, encoded as
its bytes. Forward Viterbi scores are the exact best score of every prefix, and so serve
as exact heuristic for an A* search from the end: segmentations come out best first.

No piece of the model spans a blank after another character, or a line break, so the
lattice falls into words. The text's best segmentation joins its words' best. A text's
n-best differ from it in words with the n - 1 least losses at most: forward scores that
keep the second best give every word's least loss, for whole batches of words at once, and
the search runs in the words that can matter.

Normalisation is the model's own kind: a blank before the text, blanks as U+2581, nothing
else changed. Decoding turns pieces back into the text; a text that holds U+2581 itself
comes back with blanks there, and says so in ``round_trip``.

The model given was made by pair merging: its scores are minus the ranks of merges. The
best segmentation is the one of the highest sum of scores in the lattice, as for a unigram
model; the library's own encoding of such a model merges pairs greedily by rank instead, and
need not be the same. No n-best of the library exists to compare with for this kind.

Edges. A null or empty text has no pieces and one segmentation of score 0. Fewer than n
segmentations are all returned. Ties are broken the same way every time, towards longer last
pieces of a word. Repeated rows give equal rows; an empty table an empty result; extra
columns are not read. Words and texts of any length are segmented whole; a run of thousands
of blanks, dashes or letters without a blank takes time in proportion to its length.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import mix, prepare, sliced, text_bytes, tidy

BLANK = "▁"
BEST = 4
#: Scores at or below this mark pieces that a model keeps out of the best segmentation.
FLOOR = -1e8
PENALTY = 10.0
WORDS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
#: Words remembered by a worker at a time, and longest word that is batched.
MEMORY = 200_000
LONG = 48


class _Table:
    """Stretches of one length by the hash of their characters; row 0 stands for none.

    Slots are the first bits of the hash. Pieces that share a slot lie in layers.
    """

    BITS = 17

    def __init__(self, keys: np.ndarray, ids: np.ndarray, score: np.ndarray):
        self.keys = np.concatenate([np.zeros(1, np.uint64), keys])
        self.ids = np.concatenate([np.zeros(1, np.int32), ids])
        self.score = np.concatenate([[-np.inf], score])
        self.layers: list[np.ndarray] = []
        slots = self.slot(keys)
        order = np.argsort(slots, kind="stable")
        first = np.searchsorted(slots[order], slots[order])
        depth = np.arange(len(order)) - first
        for d in range(int(depth.max()) + 1):
            layer = np.zeros(1 << self.BITS, np.int32)
            layer[slots[order][depth == d]] = order[depth == d] + 1
            self.layers.append(layer)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rows of keys; 0 where there is none."""
        slots = self.slot(keys)
        out = self.layers[0][slots]
        out[self.keys[out] != keys] = 0
        for layer in self.layers[1:]:
            more = layer[slots]
            hit = (more > 0) & (self.keys[more] == keys)
            out[hit] = more[hit]
        return out


class Pieces:
    """A model's pieces, and segmentation of single words."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>$")
        self.byte_ids, self.id_bytes, self.ids, self.score = {}, {}, {}, {}
        for i, t in enumerate(self.text):
            if m.is_byte(i):
                value = int(byte.match(t)[1], 16)
                self.byte_ids[value], self.id_bytes[i] = i, bytes([value])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.ids[t], self.score[t] = i, float(m.get_score(i))
        self.unknown_id = m.unk_id()
        self.bytes = [self.id_bytes.get(i, t.encode()) for i, t in enumerate(self.text)]
        self.longest = max(map(len, self.ids))
        usual = [s for s in self.score.values() if s > FLOOR]
        self.unknown = min(usual) - PENALTY
        crossing = [t for t in self.ids if "\n" in t or BLANK in t.lstrip(BLANK)]
        if crossing:
            raise ValueError(f"pieces span words: {crossing[:3]}")
        # For each length, all stretches that start some piece; those that are pieces have a score.
        self.tables = []
        for n in range(1, self.longest + 1):
            starts = sorted({t[:n] for t in self.ids if len(t) >= n})
            codes = np.array([[ord(c) for c in t] for t in starts], np.uint64)
            keys = np.zeros(len(starts), np.uint64)
            for k in range(n):
                keys = _extend(keys, codes[:, k])
            self.tables.append(_Table(keys, np.array([self.ids.get(t, 0) for t in starts], np.int32), np.array([self.score.get(t, -np.inf) for t in starts])))

    def spelled(self, word: str, stop: int) -> list[tuple[int, float]]:
        """(start, score) of the edges that end at ``stop``, longest first."""
        get = self.score.get
        here = [(start, s) for start in range(max(0, stop - self.longest), stop) if (s := get(word[start:stop])) is not None]
        if not here or here[-1][0] != stop - 1:
            here.append((stop - 1, self.unknown))
        return here

    def forward(self, word: str) -> np.ndarray:
        """The best score of every prefix: a number for each character, whatever its edges."""
        best = np.zeros(len(word) + 1)
        for stop in range(1, len(word) + 1):
            best[stop] = max(best[start] + s for start, s in self.spelled(word, stop))
        return best

    def nbest(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a word: (score, ids), best first.

        A* from the end: a state is a suffix segmented so far; its priority is the suffix's
        score plus the best score of the prefix left, which no completion exceeds and one
        attains, so complete segmentations leave the queue in order.

        Suffixes that start at one place leave the queue best first, and none but the ``n``
        best of them can be part of the ``n`` best segmentations: later ones are not expanded.
        Of equal priorities the longer suffix goes first, so ties don't spread. A word takes
        at most ``n`` expansions for each of its characters, however many segmentations tie.
        """
        if not word:
            return [(0.0, ())]
        best = self.forward(word)
        tick = itertools.count()
        queue = [(-best[-1], len(word), next(tick), 0.0, None)]
        out: list[tuple[float, tuple[int, ...]]] = []
        expanded = np.zeros(len(word) + 1, np.int64)
        while queue and len(out) < n:
            _, stop, _, done, chain = heapq.heappop(queue)
            if stop == 0:
                cuts, c = [0], chain
                while c is not None:
                    cuts.append(c[0])
                    c = c[1]
                out.append((done, tuple(i for a, b in zip(cuts, cuts[1:]) for i in self.spell(word[a:b]))))
                continue
            if expanded[stop] == n:
                continue
            expanded[stop] += 1
            for start, s in self.spelled(word, stop):
                heapq.heappush(queue, (-(done + s + best[start]), start, next(tick), done + s, (stop, chain)))
        return out

    def spell(self, piece: str) -> tuple[int, ...]:
        """The ids of one edge: a piece's own, or a character's bytes."""
        i = self.ids.get(piece)
        if i is not None:
            return (i,)
        return tuple(self.byte_ids.get(b, self.unknown_id) for b in piece.encode("utf-8", "replace"))

    def raw(self, ids) -> bytes:
        """The normalised text of ids, as UTF-8."""
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        text = self.raw(ids).decode("utf-8", "replace").replace(BLANK, " ")
        return text.removeprefix(" ")

    def batch(self, words: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of the words: the words, best scores, losses of the second best, and sizes and ids of the best."""
        groups: dict[int, list[str]] = {}
        for w in words:
            groups.setdefault(len(w), []).append(w)
        odd: list[str] = []
        for n, members in groups.items():
            if n > LONG:
                odd += members
                continue
            for lo in range(0, len(members), 4096):
                known, odd_here, *rest = self._batch(members[lo : lo + 4096], n)
                odd += odd_here
                yield known, *rest
        if odd:
            found = [self.nbest(w, 2) for w in odd]
            yield (
                odd,
                np.array([f[0][0] for f in found]),
                np.array([f[0][0] - f[1][0] if len(f) > 1 else np.inf for f in found]),
                np.array([len(f[0][1]) for f in found]),
                np.fromiter(itertools.chain.from_iterable(f[0][1] for f in found), np.int32),
            )

    def _batch(self, words: list[str], n: int):
        """As batch(), for words of ``n`` characters; second come those that need bytes."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)
        w = len(words)
        first, second = np.full((n + 1, w), -np.inf), np.full((n + 1, w), -np.inf)
        first[0] = 0
        back, ids = np.zeros((n + 1, w), np.int32), np.zeros((n + 1, w), np.int32)
        found = {}
        # Runs grow by a character as long as some piece starts so.
        codes = codes.T.copy()
        place = np.arange(n * w)
        keys = np.zeros(n * w, np.uint64)
        for size in range(1, min(n, self.longest) + 1):
            fits = place < (n - size + 1) * w
            place, keys = place[fits], keys[fits]
            keys = _extend(keys, codes.ravel()[place + (size - 1) * w])
            rows = self.tables[size - 1].find(keys)
            known = rows > 0
            place, keys, rows = place[known], keys[known], rows[known]
            if not len(place):
                break
            score, piece = np.full(n * w, -np.inf), np.zeros(n * w, np.int32)
            score[place], piece[place] = self.tables[size - 1].score[rows], self.tables[size - 1].ids[rows]
            score = score.reshape(n, w)
            some = np.isfinite(score).any(axis=1)
            if some.any():
                found[size] = (score, piece.reshape(n, w), some)
        for stop in range(1, n + 1):
            for size in sorted((s for s in found if s <= stop), reverse=True):
                scores, pieces, some = found[size]
                if not some[stop - size]:
                    continue
                one, two = first[stop - size] + scores[stop - size], second[stop - size] + scores[stop - size]
                better = one > first[stop]
                second[stop] = np.where(better, np.maximum(first[stop], two), np.maximum(second[stop], one))
                np.copyto(first[stop], one, where=better)
                back[stop][better] = size
                np.copyto(ids[stop], pieces[stop - size], where=better)
        known = np.isfinite(first).all(axis=0)
        if not known.all():
            odd = list(itertools.compress(words, ~known))
            words = list(itertools.compress(words, known))
            first, second, back, ids = first[:, known], second[:, known], back[:, known], ids[:, known]
        else:
            odd = []
        at, col = np.full(len(words), n), np.arange(len(words))
        trail: list[np.ndarray] = []
        while (at > 0).any():
            trail.append(np.where(at > 0, ids[at, col], -1))
            at = at - back[at, col]
        table = np.array(trail[::-1]).T if trail else np.zeros((len(words), 0), np.int32)
        there = table >= 0
        return words, odd, first[n], first[n] - second[n], there.sum(axis=1), table[there].astype(np.int32)


def _extend(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hashes of runs that are one character longer."""
    with np.errstate(over="ignore"):
        return mix(keys + codes + np.uint64(1))


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def split(text: str) -> list[str]:
    """The words of a text's lattice, after normalisation."""
    return WORDS.findall(BLANK + text.replace(" ", BLANK)) if text else []


def combine(total: float, choices: list[list[tuple[float, tuple[int, ...]]]], n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best joint choices, as (score, index of the choice of each word)."""
    best = [(0.0, ())]
    for options in choices:
        grown = [(loss + options[0][0] - s, picks + (k,)) for loss, picks in best for k, (s, _) in enumerate(options)]
        best = heapq.nsmallest(n, grown)
    return [(total - loss, list(picks)) for loss, picks in best]


class Memory:
    """Words that a worker has segmented: numbers by word, and what is known by number."""

    def __init__(self, model: Pieces):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.score, self.loss, self.starts = np.zeros(0), np.zeros(0), np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.best: dict[str, list] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.at) + len(words) > MEMORY:
            self.clear()
        new = [w for w in words if w not in self.at]
        found = list(self.model.batch(new))
        if not found:
            return
        names = list(itertools.chain.from_iterable(f[0] for f in found))
        self.at.update(zip(names, range(len(self.at), len(self.at) + len(names))))
        self.score = np.concatenate([self.score, *(f[1] for f in found)])
        self.loss = np.concatenate([self.loss, *(f[2] for f in found)])
        sizes = np.concatenate([f[3] for f in found])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, *(f[4] for f in found)])

    def nbest(self, word: str, n: int) -> list:
        if word not in self.best:
            self.best[word] = self.model.nbest(word, n)
        return self.best[word]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of words, of which the new ones are learned first; distinct ones are looked up once."""
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn(set(distinct))
        return np.fromiter(map(self.at.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]

    def encode(self, words: list[str], no: np.ndarray, n: int) -> tuple[np.ndarray, list[float], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """Ids of the best segmentation of words and their numbers, the ``n`` best scores, and the edits of the others.

        An edit (at, drop, ids) puts ``ids`` in the place of ``drop`` ids of the best from ``at`` on.
        """
        sizes = self.starts[no + 1] - self.starts[no]
        ends = np.cumsum(sizes)
        count = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[no] - (ends - sizes), sizes) + np.arange(count)]
        loss = self.loss[no]
        few = min(n - 1, len(words))
        order = np.argpartition(loss, few - 1)[:few] if 0 < few < len(words) else np.arange(few)
        order = np.sort(order).tolist()
        choices = [self.nbest(words[i], n) for i in order]
        scores, edits = [], []
        for score, picks in combine(float(self.score[no].sum()), choices, n):
            scores.append(score)
            edits.append([(int(ends[i] - sizes[i]), int(sizes[i]), o[k][1]) for i, o, k in zip(order, choices, picks) if k])
        return ids, scores, edits[1:]


def edited(best: list[int], edits) -> list[int]:
    """The ids of another segmentation, from those of the best and its edits (at, drop, ids) in order."""
    out, last = [], 0
    for at, drop, ids in edits:
        out += [*best[last:at], *ids]
        last = at + drop
    return out + list(best[last:])


def encode_nbest(text: str, path: str, n: int = BEST) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of a text: (score, ids), best first."""
    memory, words = Memory(load(path)), split(text)
    ids, scores, edits = memory.encode(words, memory.numbers(words), n)
    best = ids.tolist()
    return [(score, edited(best, e)) for score, e in zip(scores, [[], *edits])]


def lists(rows: list[np.ndarray]) -> pa.Array:
    """Arrays of ids as one Arrow array of lists."""
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]), pa.int32()))


EDITS = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def edit_lists(rows: list[list[list[tuple]]]) -> pa.Array:
    """Edits of each row's other segmentations as one Arrow array."""
    made = [[[{"at": a, "drop": d, "ids": list(i)} for a, d, i in one] for one in row] for row in rows]
    return pa.array(made, EDITS)


def _encoder(path: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        memory = Memory(model)
        for part in sliced(batches, -1):
            last = part.num_columns - 1
            best, others, scores, exact = [], [], [], []
            raw = [x.as_py() for x in part.column(last)]
            texts = [split(t.decode("utf-8", "replace")) for t in raw]
            no = memory.numbers(list(itertools.chain.from_iterable(texts)))
            parts = np.split(no, np.cumsum([len(w) for w in texts])[:-1])
            for text, words, own in zip(raw, texts, parts):
                ids, found, edits = memory.encode(words, own, n)
                best.append(ids)
                others.append(edits)
                scores.append(found)
                exact.append(model.raw(ids.tolist()).replace(BLANK.encode(), b" ")[bool(words) :] == text)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(k) for k in range(last)),
                    lists(best),
                    pa.array([len(i) for i in best], pa.int64()),
                    pa.array(scores, pa.list_(pa.float64())),
                    edit_lists(others),
                    pa.array(exact, pa.bool_()),
                ],
                [*part.schema.names[:last], "piece_ids", "n_pieces", "nbest_scores", "nbest_edits", "round_trip"],
            )

    return run


ENCODED = "piece_ids array<int>, n_pieces long, nbest_scores array<double>, nbest_edits array<array<struct<at:int,drop:int,ids:array<int>>>>, round_trip boolean"


def encode_rows(docs: DataFrame, keep: tuple[str, ...], path: str, n: int = BEST) -> DataFrame:
    """The columns ``keep`` of every row, and its piece_ids, n_pieces, nbest_scores, nbest_edits and round_trip.

    ``piece_ids`` is the best segmentation and ``nbest_scores`` has the scores of all ``n``.
    ``nbest_edits`` holds the second to the ``n``-th as what differs from the best in order of
    place, a few words each; ``segmentations`` writes them out.
    """
    prepare(docs.sparkSession)
    rows = docs.select(*keep, text_bytes().alias("text"))
    kept = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(tidy(_encoder(path, n)), f"{kept}, {ENCODED}")


def encode(docs: DataFrame, path: str, n: int = BEST) -> DataFrame:
    """doc_id, piece_ids, n_pieces, nbest_scores, nbest_edits and round_trip of every document."""
    return encode_rows(docs, ("doc_id",), path, n)


def segmentations(encoded: DataFrame) -> DataFrame:
    """doc_id, rank (from 1), score and piece_ids: every segmentation of every row of ``encoded`` in full."""
    best = F.col("piece_ids")

    def spelled(edits: Column) -> Column:
        """Pieces between the edits, and the edits, in order."""
        stops = F.concat(F.transform(edits, lambda e: e["at"]), F.array(F.size(best)))
        starts = F.concat(F.array(F.lit(0)), F.transform(edits, lambda e: e["at"] + e["drop"]))
        kept = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda x: F.slice(best, x["a"] + 1, x["b"] - x["a"]))
        return F.flatten(F.zip_with(kept, F.transform(edits, lambda e: e["ids"]), lambda k, i: F.concat(k, F.coalesce(i, F.array().cast("array<int>")))))

    none = F.array(F.array().cast("array<struct<at:int,drop:int,ids:array<int>>>"))
    every = F.arrays_zip(F.col("nbest_scores").alias("score"), F.concat(none, F.col("nbest_edits")).alias("edits"))
    rows = encoded.select("doc_id", "piece_ids", F.posexplode(every).alias("at", "one"))
    return rows.select("doc_id", (F.col("at") + 1).alias("rank"), F.col("one.score").alias("score"), spelled(F.col("one.edits")).alias("piece_ids"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, piece_ids)."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.decode(x.as_py() or []) for x in b.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "piece_ids").mapInArrow(run, "doc_id long, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
