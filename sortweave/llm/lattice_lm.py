"""Subword lattice likelihood: the probability of a text over all its segmentations.

The pieces of a public subword vocabulary span a lattice over each word (with the blank before it), and so does
the word itself, as one edge, if training texts have it. Forward recursion in log space sums over all paths.
A vocabulary with log-probabilities weights the lattice as it is. One whose scores are ranks weights a first lattice by them; expected counts
of pieces over the distinct training words, each once whatever block or how many copies it stands in, give the weights of the next, for ROUNDS rounds.

With c occurrences of a word, N training tokens and V distinct ones, its probability is (c + (V + 1/2) * L) / (N + V + 1), L
being the product sum over its pieces: pieces that begin a word are one distribution, all others and the stop
another. The end token has (c + 1/2) / (N + V + 1). So all texts together have probability 1, which the add-one baseline
beside it, (c + 1) / (N + V + 1) for every unknown word, does not keep to. Counts are exact over all training documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortweave.llm.common import ascii_crc_bucket, columns_free_of, keep, utf8

#: Bytes of text that are treated together.
BLOCK = 16 << 20
#: Rounds of expected counts, where a vocabulary has ranks.
ROUNDS = 2
#: Added to the expected count of every piece, and to a rank that is taken as a Zipf weight.
SMOOTH, RANK = 0.1, 10.0
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_SPACE, _STOP = b" ", -2


def vocabulary(path: str | None = None) -> list[tuple[bytes, float]]:
    """(piece, score) of a sentencepiece model file, pieces as bytes with a blank for the word mark; byte pieces are
    single bytes. Scores are log-probabilities, or ranks below 0. Control pieces, pieces with a capital A-Z and pieces with a word mark inside match no text and are left out."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    best: dict[bytes, float] = {}
    scores = [model.get_score(i) for i in range(model.vocab_size())]
    least = -float(model.vocab_size()) if by_rank(scores) else min(scores) - 10.0
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        text = model.id_to_piece(i)
        piece = bytes([int(text[3:5], 16)]) if model.is_byte(i) else text.replace("▁", " ").encode()
        if piece != piece.lower() or _SPACE in piece[1:]:
            continue
        best[piece] = max(best.get(piece, -np.inf), least if model.is_byte(i) else scores[i])
    for b in range(256):
        best.setdefault(bytes([b]), least)
    return sorted(best.items())


def by_rank(scores: list[float]) -> bool:
    """Whether scores are ranks, as a vocabulary of merges has: whole numbers."""
    return all(float(x).is_integer() for x in scores)


def normalise(pieces: list[bytes], log_weight: np.ndarray, stop: float) -> tuple[np.ndarray, float]:
    """Log-probabilities: of pieces that begin a word, and of all others with the stop."""
    begins = np.array([p[:1] == _SPACE for p in pieces])
    out = log_weight - np.where(begins, np.logaddexp.reduce(log_weight[begins]), np.logaddexp(np.logaddexp.reduce(log_weight[~begins]), stop))
    return out, float(stop - np.logaddexp(np.logaddexp.reduce(log_weight[~begins]), stop))


@dataclass
class Trie:
    """Prefixes of all pieces by rolling hash, in arrays sorted by it: whether a prefix exists, and the piece it is."""

    hashes: np.ndarray
    starts: np.ndarray
    shift: int
    steps: int
    piece: np.ndarray
    longest: int

    @classmethod
    def of(cls, pieces: list[bytes]) -> "Trie":
        prefixes: dict[bytes, int] = {}
        for i, p in enumerate(pieces):
            for n in range(1, len(p)):
                prefixes.setdefault(p[:n], -1)
            prefixes[p] = i
        keys = np.array([_hash(p) for p in prefixes], np.uint64)
        order = np.argsort(keys)
        hashes = keys[order]
        bits = max(1, int(np.ceil(np.log2(4 * len(hashes)))))
        cuts = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        return cls(hashes, cuts[:-1].astype(np.int32), 64 - bits, int(np.diff(cuts).max()), np.fromiter(prefixes.values(), np.int64)[order], max(map(len, pieces)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each prefix, or -1."""
        at, last = self.starts[h >> np.uint64(self.shift)], len(self.hashes) - 1
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        for step in range(self.steps):
            place = np.minimum(at[open_] + step, last)
            found = self.hashes[place]
            hit = found == h[open_]
            out[open_[hit]] = place[hit]
            open_ = open_[~hit & (found < h[open_])]
            if not len(open_):
                break
        return out


def _hash(p: bytes) -> int:
    h = 0
    for c in p:
        h = ((h + c + 1) * int(_BASE)) & (2**64 - 1)
    return (h * int(_MIX)) & (2**64 - 1)


def edges(trie: Trie, letters: np.ndarray, lengths: np.ndarray):
    """For words in rows of ``letters``: for each piece length the (word, start, piece) of all pieces that match."""
    n, width = letters.shape
    word, start = np.nonzero(np.arange(width)[None, :] < lengths[:, None])
    h = np.zeros(len(word), np.uint64)
    out = []
    for size in range(1, min(trie.longest, width) + 1):
        end = start + size - 1
        inside = end < lengths[word]
        word, start, h, end = word[inside], start[inside], h[inside], end[inside]
        h = (h + letters[word, end].astype(np.uint64) + np.uint64(1)) * _BASE
        at = trie.find(h * _MIX)
        on = at >= 0
        word, start, h = word[on], start[on], h[on]
        piece = trie.piece[at[on]]
        full = piece >= 0
        out.append((size, word[full], start[full], piece[full]))
        if not len(word):
            break
    return out


def _tables(found, n: int, width: int, log_p: np.ndarray) -> np.ndarray:
    """score[size - 1, start, word] of each piece, -inf where there is none."""
    score = np.full((len(found), width, n), -np.inf)
    for size, word, start, piece in found:
        score[size - 1, start, word] = log_p[piece]
    return score


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe).sum(axis=0))


def forward(score: np.ndarray, width: int) -> np.ndarray:
    """alpha[j, word]: log of the summed weight of all ways to the first j bytes."""
    sizes, _, n = score.shape
    alpha = np.full((width + 1, n), -np.inf)
    alpha[0] = 0
    for j in range(1, width + 1):
        k = min(sizes, j)
        alpha[j] = _log_sum(np.stack([alpha[j - s] + score[s - 1, j - s] for s in range(1, k + 1)]))
    return alpha


def backward(score: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """beta[i, word]: log of the summed weight of all ways from byte i to the word's end."""
    sizes, _, n = score.shape
    beta = np.full((width + 1, n), -np.inf)
    beta[lengths, np.arange(n)] = 0
    for i in range(width - 1, -1, -1):
        k = min(sizes, width - i)
        beta[i] = np.logaddexp(beta[i], _log_sum(np.stack([beta[i + s] + score[s - 1, i] for s in range(1, k + 1)])))
    return beta


def _groups(words: list[bytes], cells: int = 150_000):
    """Indices of words of like lengths, so many that a table of their letters has about ``cells`` cells."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, min(cells // int(lengths[order[at]]), len(order) - at))
        while n > 1 and lengths[order[at + n - 1]] * n > 2 * cells:
            n //= 2
        yield order[at : at + n], lengths[order[at : at + n]]
        at += n


def _letters(words: list[bytes], lengths: np.ndarray) -> np.ndarray:
    width = int(lengths.max())
    joined = b"".join((_SPACE + w).ljust(width, b"\0") for w in words)
    return np.frombuffer(joined, np.uint8).reshape(len(words), width)


#: Words longer than this are scored byte by byte, in memory that grows with the word alone.
LONG = 512


def log_probabilities(trie: Trie, log_p: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural log of each word's marginal probability over all segmentations."""
    out = np.zeros(len(words))
    for index, lengths in _groups(words):
        own = [words[i] for i in index]
        if lengths[-1] > LONG:
            out[index] = [_long(trie, log_p, w) for w in own]
            continue
        letters = _letters(own, lengths)
        width = letters.shape[1]
        alpha = forward(_tables(edges(trie, letters, lengths), len(own), width, log_p), width)
        out[index] = alpha[lengths, np.arange(len(own))]
    return out


def _long(trie: Trie, log_p: np.ndarray, word: bytes, counts: np.ndarray | None = None, weight: float = 0.0) -> float:
    """One long word, by the same recursion over its sorted edges; adds expected counts if asked."""
    n = len(word) + 1
    found = edges(trie, _letters([word], np.array([n])), np.array([n]))
    size = np.concatenate([np.full(len(f[2]), f[0]) for f in found])
    start, piece = (np.concatenate([f[i] for f in found]) for i in (2, 3))
    order = np.argsort(start + size, kind="stable")
    size, start, piece = size[order], start[order], piece[order]
    first = np.searchsorted(start + size, np.arange(n + 2))
    alpha = np.full(n + 1, -np.inf)
    alpha[0] = 0
    for j in range(1, n + 1):
        s = slice(first[j], first[j + 1])
        alpha[j] = np.logaddexp.reduce(alpha[start[s]] + log_p[piece[s]])
    if counts is not None:
        beta = np.full(n + 1, -np.inf)
        beta[n] = 0
        for j in range(n, 0, -1):
            s = slice(first[j], first[j + 1])
            beta[start[s]] = np.logaddexp(beta[start[s]], beta[j] + log_p[piece[s]])
        np.add.at(counts, piece, weight * np.exp(alpha[start] + log_p[piece] + beta[start + size] - alpha[n]))
    return float(alpha[n])


def expected_counts(trie: Trie, log_p: np.ndarray, words: list[bytes], n: np.ndarray) -> np.ndarray:
    """How often each piece is used in the words (word i occurs n[i] times), over all segmentations by their weight."""
    counts = np.zeros(len(log_p))
    for index, lengths in _groups(words):
        own = [words[i] for i in index]
        if lengths[-1] > LONG:
            for i, w in zip(index, own, strict=True):
                _long(trie, log_p, w, counts, float(n[i]))
            continue
        letters = _letters(own, lengths)
        width, m = letters.shape[1], len(own)
        found = edges(trie, letters, lengths)
        score = _tables(found, m, width, log_p)
        alpha, beta = forward(score, width), backward(score, lengths, width)
        whole = alpha[lengths, np.arange(m)]
        for size, word, start, piece in found:
            use = np.exp(alpha[start, word] + log_p[piece] + beta[start + size, word] - whole[word]) * n[index][word]
            counts += np.bincount(piece, weights=use, minlength=len(counts))
    return counts


def split(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()


_TOKENS = "block bigint, doc_ids array<bigint>, held_out array<boolean>, sizes array<int>, numbers array<int>, at int, n int, word binary"
_TOKEN_TYPES = {"block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "held_out": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int32()), "numbers": pa.list_(pa.int32()), "at": pa.int32(), "n": pa.int32(), "word": pa.binary()}


def _rows(count: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(count, t) for k, t in _TOKEN_TYPES.items()], list(_TOKEN_TYPES))


def _tokens(size: int):
    """Blocks of about ``size`` bytes of text: a row with the number of each token's word in the block, and a row (at, n, word) for each distinct word, n times in training texts."""

    def block(number, ids, held, known, numbers, sizes):
        flat, each = np.concatenate(numbers), np.array(sizes, np.int64)
        n = np.bincount(flat[np.repeat(~np.array(held, bool), each)], minlength=len(known))
        yield _rows(1, block=[number], doc_ids=[ids], held_out=[held], sizes=[sizes], numbers=[flat])
        words = list(known)
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            yield _rows(len(some), block=np.full(len(some), number), at=np.arange(at, at + len(some)), n=n[at : at + 50_000], word=some)

    def run(batches):
        number = TaskContext.get().partitionId() << 30
        ids, held, known, numbers, sizes, n = [], [], {}, [], [], 0
        for b in batches:
            for doc_id, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = split(text.as_py())
                for w in words:
                    known.setdefault(w, len(known))
                numbers.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                held.append(out)
                sizes.append(len(words))
                n += (text.as_buffer().size if text.is_valid else 0) + 64
                if n >= size:
                    yield from block(number, ids, held, known, numbers, sizes)
                    number, ids, held, known, numbers, sizes, n = number + 1, [], [], {}, [], [], 0
        if ids:
            yield from block(number, ids, held, known, numbers, sizes)

    return run


def _learn(sent):
    """(piece, uses): expected counts of pieces, and of stops, over words that count once each."""

    def run(batches):
        trie, log_p = sent.value
        uses, stops = np.zeros(len(log_p)), 0
        for b in batches:
            uses += expected_counts(trie, log_p, b.column(0).to_pylist(), np.ones(b.num_rows, np.int64))
            stops += b.num_rows
        used = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, _STOP).astype(np.int64)), pa.array(np.append(uses[used], float(stops)))], ["piece", "uses"])

    return run


def _marginals(sent):
    """(word, c, m): log10 of what a word has of the N + V + 1, its count and its share by the lattice together."""

    def run(batches):
        trie, log_p, log_stop, distinct = sent.value
        for b in batches:
            lattice = np.exp(log_probabilities(trie, log_p, b.column(0).to_pylist()) + log_stop)
            c = b.column(1).to_numpy(zero_copy_only=False)
            with np.errstate(divide="ignore"):
                m = np.log10(c + (distinct + 0.5) * lattice)
            if (flat := np.flatnonzero(~np.isfinite(m))).size:  # unknown words so long that their probability is no double: by its logarithm
                own = [b.column(0)[int(i)].as_py() for i in flat]
                m[flat] = (log_probabilities(trie, log_p, own) + log_stop + np.log(distinct + 0.5)) / np.log(10)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c), pa.array(m)], ["word", "c", "m"])

    return run


def _totals(total: int, distinct: int, ends: int):
    scale = np.log10(total + distinct + 1)

    def run(told: pa.Table, block: pa.Table) -> pa.Table:
        """A block's documents, from what is told of its distinct words."""
        row = {k: block[k][0].values for k in ("doc_ids", "held_out", "sizes", "numbers")}
        number, sizes = row["numbers"].to_numpy(zero_copy_only=False), row["sizes"].to_numpy(zero_copy_only=False).astype(np.int64)
        c, m = np.zeros(told.num_rows, np.int64), np.zeros(told.num_rows)
        at = told["at"].to_numpy()
        c[at], m[at] = told["c"].to_numpy(), told["m"].to_numpy()
        first = np.concatenate([[0], np.cumsum(sizes)])

        def sums(of):
            along = np.concatenate([[0], np.cumsum(of[number])])
            return along[first[1:]] - along[first[:-1]]

        tokens = sizes + 1
        return pa.table({
            "doc_id": row["doc_ids"], "held_out": row["held_out"], "n_tokens": tokens, "n_known": sums(c > 0) + int(ends > 0), "train_tokens": np.full(len(tokens), total, np.int64),
            "base_score": sums(np.log10(c + 1.0)) + np.log10(ends + 1.0) - tokens * scale, "score": sums(m) + np.log10(ends + 0.5) - tokens * scale,
        })

    return run


def score(docs: DataFrame, held: str = "held_out", pieces: list[tuple[bytes, float]] | None = None, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of (doc_id, text, ``held``).

    ``pieces``: (piece, score); log-probabilities are kept as they are, ranks (whole numbers) are learnt from, ``rounds`` times. Learns from the rows that
    aren't held out, all of them. Null and blank texts are the end token alone; null ids stay
    null; repeated rows count and are scored each; with nothing to learn from, counts are 0; an empty table gives none; further columns are left out.

    Texts are read once, to blocks of bounded size: numbers of tokens, and the block's distinct words. Counts of words are summed map-side
    first. The lattice is run once for each distinct word of the corpus; the join that takes its result back to the blocks has a row a block for a
    frequent word, which Spark's skew join can split. Pieces' expected counts are a vocabulary's worth of numbers for each task, summed by Spark.
    """
    spark = docs.sparkSession
    table = pieces or vocabulary()
    names, scores = [p for p, _ in table], np.array([s for _, s in table])
    trie = Trie.of(names)
    ranked = by_rank(scores.tolist())
    log_p, log_stop = normalise(names, -np.log(RANK - scores) if ranked else scores, 0.0)
    rows = columns_free_of(docs, ["doc_id", held, "text"]).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(held), F.lit(False)).alias(held), "text")
    tokens = keep(rows.mapInArrow(_tokens(block), _TOKENS), "lm-tokens")
    blocks = tokens.where("doc_ids is not null").select("block", "doc_ids", "held_out", "sizes", "numbers")
    each = tokens.where("word is not null").select("block", "at", "n", "word")
    documents = blocks.agg(F.coalesce(F.sum(F.size(F.filter("held_out", lambda x: ~x))), F.lit(0))).first()[0]
    words = keep(each.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    found = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count_if(F.col("c") > 0).alias("distinct")).first()

    for _ in range(rounds if ranked else 0):
        learnt = words.where("c > 0").select("word").mapInArrow(_learn(spark.sparkContext.broadcast((trie, log_p))), "piece bigint, uses double")
        counts, stops = np.zeros(len(table)), 0.0
        for r in learnt.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # a row for each piece of the vocabulary
            if r["piece"] == _STOP:
                stops = r["uses"]
            else:
                counts[r["piece"]] = r["uses"]
        log_p, log_stop = normalise(names, np.log(counts + SMOOTH), float(np.log(stops + SMOOTH)))

    distinct = found["distinct"] + (documents > 0)
    sent = spark.sparkContext.broadcast((trie, log_p, log_stop, distinct))
    told = each.select("block", "at", "word").join(words.mapInArrow(_marginals(sent), "word binary, c bigint, m double"), "word").select("block", "at", "c", "m")
    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    own = blocks.withColumnRenamed("block", "own")  # another name, as both sides come from one table
    return told.groupBy("block").cogroup(own.groupBy("own")).applyInArrow(_totals(found["tokens"] + documents, distinct, documents), out)


def op4_subword_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; six in seven, by their ids, are learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.withColumn("held_out", ascii_crc_bucket(F.col("doc_id"), 7) == 2))
