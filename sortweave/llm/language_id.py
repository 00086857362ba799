"""Language identification by interpolated Kneser-Ney character models.

One model for each language, all in shared arrays sorted by a hash of the n-gram: a row has the
log-probability of its last character in every language. A text's language is that of the lowest cross-entropy
a character; a text that even its best language explains much worse than held-back training texts is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortweave.llm.common import ascii_crc_bucket, columns_free_of, lean

ORDER = 4
#: Documents of each language that the models learn from, about, and as many again to calibrate on: a bounded, random sample.
TRAIN_DOCS, CALIBRATION_DOCS = 2000, 500
#: Standard deviations above the usual cross-entropy at which a text is rejected.
REJECT = 8.0
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _short(codes: np.ndarray) -> np.ndarray:
    """16 bits for each character: its own code, or for one beyond them a place among those of private use, where no letter is."""
    return np.where(codes <= 0xFFFF, codes, 0xE000 + codes * np.uint32(2654435761) % np.uint32(6400))


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters with single blanks for all else, ORDER - 1 blanks before each text.

    Returns codes, the text each belongs to, and whether it counts (not the blanks put before).
    """
    gap = "\0" * (ORDER - 1)
    joined = gap + gap.join(t.replace("\0", " ").lower() for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, edge = _letters()[codes], codes == 0
    before = np.concatenate([[False], letter[:-1]])
    keep = letter | edge | before
    codes = np.where(letter, _short(codes), _SPACE)[keep].astype(np.uint64)
    edge = edge[keep]
    return codes, np.cumsum(edge) // (ORDER - 1) - 1, ~edge


def grams(codes: np.ndarray) -> np.ndarray:
    """The last ORDER codes at each place, 16 bits each, the nearest lowest."""
    key = codes.copy()
    for i in range(1, ORDER):
        key[i:] |= codes[:-i] << np.uint64(16 * i)
    return key


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (16 * n)) - 1)


@dataclass
class SortedHashes:
    """Keys sorted by a one-to-one hash; the places of its leading bits shorten the search to a few steps."""

    hashes: np.ndarray
    starts: np.ndarray
    shift: int
    steps: int

    @classmethod
    def of(cls, keys: np.ndarray) -> tuple["SortedHashes", np.ndarray]:
        """The table, and the order in which rows that go with ``keys`` are to be put."""
        hashes = keys * _MIX
        order = np.argsort(hashes)
        hashes = hashes[order]
        bits = max(1, int(np.ceil(np.log2(4 * len(keys) + 1))))
        starts = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        return cls(hashes, starts[:-1].astype(np.int32), 64 - bits, int(np.diff(starts).max(initial=0))), order

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        h = keys * _MIX
        at = self.starts[h >> np.uint64(self.shift)]
        out = np.full(len(keys), -1, np.int64)
        if not len(self.hashes):
            return out
        last = len(self.hashes) - 1
        hit = self.hashes[np.minimum(at, last)] == h
        out[hit] = at[hit]
        open_ = np.flatnonzero(~hit)
        for step in range(1, self.steps):
            if not len(open_):
                break
            place = np.minimum(at[open_] + step, last)
            hit = self.hashes[place] == h[open_]
            out[open_[hit]] = place[hit]
            open_ = open_[~hit]
        return out


@dataclass
class Models:
    languages: list[str]
    tables: list[tuple[SortedHashes, np.ndarray]] = field(default_factory=list)  # by order 1..ORDER: log p of the last code
    backoffs: list[tuple[SortedHashes, np.ndarray]] = field(default_factory=list)  # by context length 0..ORDER-1: log of the weight given to the shorter context
    floor: np.ndarray | None = None
    usual: float = 0.0
    spread: float = 1.0
    noise: float = 1.0
    temperature: float = 1.0

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """Natural log of each n-gram's last character given the others, for every language."""
        out = np.empty((len(keys), len(self.languages)), np.float32)
        self._fill(out, keys, np.arange(len(keys)), ORDER)
        return out

    def _fill(self, out, keys, rows, order):
        if order == 0:
            out[rows] = self.floor
            return
        hashes, values = self.tables[order - 1]
        at = hashes.find(keys & _mask(order))
        hit = at >= 0
        if hit.all():
            out[rows] = values[at]
            return
        out[rows[hit]] = values[at[hit]]
        miss, left = rows[~hit], keys[~hit]
        self._fill(out, left, miss, order - 1)
        hashes, values = self.backoffs[order - 1]
        at = hashes.find((left & _mask(order)) >> np.uint64(16))
        seen = at >= 0
        out[miss[seen]] += values[at[seen]]


def kneser_ney(keys: np.ndarray, language: np.ndarray, counts: np.ndarray, languages: list[str]) -> Models:
    """Interpolated Kneser-Ney models from counts of ORDER-grams (key, language, count): raw counts at the top, below
    the number of different characters before; one absolute discount for each order and language."""
    model, total = Models(languages), len(languages)
    by_order = {}
    for n in range(ORDER, 0, -1):
        by_order[n] = (keys, language, counts)
        if n > 1:
            pairs, counts = np.unique(np.stack([keys & _mask(n - 1), language.astype(np.uint64)]), axis=1, return_counts=True)
            keys, language = pairs[0], pairs[1].astype(np.int64)
    vocabulary = len(np.unique(by_order[1][0])) + 1
    model.floor = np.full(total, -np.log(vocabulary), np.float32)
    for n in range(1, ORDER + 1):
        keys, language, counts = by_order[n]
        grams_, row = np.unique(keys, return_inverse=True)
        contexts, context = np.unique(keys >> np.uint64(16), return_inverse=True)
        sums, kinds = np.zeros((len(contexts), total)), np.zeros((len(contexts), total))
        np.add.at(sums, (context, language), counts)
        np.add.at(kinds, (context, language), 1)
        once, twice = (np.bincount(language[counts == c], minlength=total) for c in (1, 2))
        discount = np.clip(once / np.maximum(1, once + 2 * twice), 0.1, 0.95)
        weight = np.where(sums > 0, discount * kinds / np.maximum(sums, 1), 1.0)
        seen = np.zeros((len(grams_), total))
        seen[row, language] = np.maximum(counts - discount[language], 0)
        of = np.searchsorted(contexts, grams_ >> np.uint64(16))
        lower = np.empty((len(grams_), total), np.float32)
        model._fill(lower, grams_, np.arange(len(grams_)), n - 1)
        p = seen / np.maximum(sums[of], 1) + weight[of] * np.exp(lower)
        for into, k, values in ((model.tables, grams_, np.log(p)), (model.backoffs, contexts, np.log(weight))):
            table, order = SortedHashes.of(k)
            into.append((table, values[order].astype(np.float32)))
    return model


#: Characters that are scored together; a longer text is scored in stretches of this length.
STRETCH = 1 << 19


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes, owner, counts = characters(texts)
    return grams(codes)[counts], owner[counts]


def _stretches(text: str):
    """The n-grams of one long text, a stretch at a time; each begins with the codes that the one before ended in."""
    carry = np.full(ORDER - 1, _SPACE, np.uint64)
    for at in range(0, len(text), STRETCH):
        part = text[at : at + STRETCH]
        codes, _, counts = characters([part])
        codes = codes[counts]
        if carry[-1] != _SPACE and not part[0].lower()[0].isalpha():
            codes = np.concatenate([[np.uint64(_SPACE)], codes])
        codes = np.concatenate([carry, codes])
        yield grams(codes)[ORDER - 1 :]
        carry = codes[-(ORDER - 1) :]


def entropies(model: Models, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text and language the mean -log p a character; the characters; whether there is a letter."""
    sums, n = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        if len(texts[at]) > STRETCH:
            for keys in _stretches(texts[at]):
                sums[at] -= model.log_p(keys).sum(axis=0, dtype=np.float64)
                n[at] += len(keys)
            at += 1
            continue
        end, size = at + 1, len(texts[at])
        while end < len(texts) and len(texts[end]) <= STRETCH and (size := size + len(texts[end]) + ORDER) <= 2 * STRETCH:
            end += 1
        keys, owner = _counted(texts[at:end])
        own = np.bincount(owner, minlength=end - at)
        full = np.flatnonzero(own)
        if len(full):
            sums[at + full] = -np.add.reduceat(model.log_p(keys), np.searchsorted(owner, full), axis=0, dtype=np.float64)
        n[at:end] = own
        at = end
    return sums / np.maximum(n, 1)[:, None], n, n > 0


def calibrate(model: Models, texts: list[str], truth: np.ndarray) -> Models:
    """Sets what cross-entropy is usual and how it spreads with length, and the temperature of the scores."""
    h, n, full = entropies(model, texts)
    return _fitted(model, h[full], n[full], truth[full])


def _fitted(model: Models, h: np.ndarray, n: np.ndarray, truth: np.ndarray) -> Models:
    """As ``calibrate``, from cross-entropies (text, language), characters and languages of texts with a letter."""
    if not len(n):
        return model
    best = h.min(axis=1)
    model.usual = float(np.average(best, weights=n))
    off = (best - model.usual) ** 2
    model.noise = float(max(1.0, np.median(off * n) / 0.455))  # the variance a character, by the median of a squared normal
    model.spread = float(max(0.02, np.quantile(np.abs(best - model.usual), 0.9)))
    losses = {}
    for t in (1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01):
        logits = -h * n[:, None] * t
        losses[t] = np.mean(np.logaddexp.reduce(logits, axis=1) - logits[np.arange(len(h)), truth])
    model.temperature = min(losses, key=losses.get)
    return model


def _scored(sent):
    """(lang, n, h): characters and cross-entropies in all languages of each text with a letter."""

    def run(batches):
        for b in batches:
            for start, length in _slices(b.column(1)):
                own = b.slice(start, length)
                h, n, full = entropies(sent.value, own.column(1).to_pylist())
                arrays = [own.column(0).filter(pa.array(full)), pa.array(n[full]), pa.array(list(h[full]), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "n", "h"])

    return run


def decide(model: Models, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    h, n, full = entropies(model, [t or "" for t in texts])
    best = h.argmin(axis=1)
    lead = np.exp(-(h - h.min(axis=1, keepdims=True)) * n[:, None] * model.temperature)
    score = np.where(full, 1 / lead.sum(axis=1), 0.0)
    limit = model.usual + REJECT * np.sqrt(model.spread**2 + model.noise / np.maximum(n, 1))
    least = h.min(axis=1)
    rejected = ~full | (least > limit)
    score = np.where(rejected & full, score * limit / np.maximum(least, limit), score)  # the further beyond the limit, the less sure
    return [model.languages[b] if f else "und" for b, f in zip(best, full, strict=True)], score, rejected


def _count(batches):
    """(lang, key, count) of ORDER-grams, summed over each batch."""
    for b in batches:
        langs = b.column(0).to_pylist()
        codes, owner, counts = characters(b.column(1).to_pylist())
        keys, owner = grams(codes)[counts], owner[counts]
        names = sorted(set(langs))
        language = np.array([names.index(x) for x in langs], np.int64)[owner] if len(owner) else owner
        for i, name in enumerate(names):
            k, c = np.unique(keys[language == i], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c)], ["lang", "key", "n"])


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> Models:
    """Learns from (doc_id, text, lang) of documents that are not held out and have a language.

    Of each language about ``train_docs`` documents are used whole, by a hash of the id, and about
    ``calibration_docs`` others to calibrate; languages with fewer are used whole, a fifth of it to calibrate,
    or nothing of it where that would leave none to learn from.
    N-grams are counted and calibration texts scored on the executors; the driver gets the sample's distinct n-grams and a few numbers a calibration text.
    """
    usable = columns_free_of(docs, ["doc_id", "text", "lang"]).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    lot = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    wanted = train_docs + calibration_docs
    seen = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.min(lot).alias("least")).collect()  # a row for each language
    sizes = {r["lang"]: r["docs"] for r in seen}
    if not sizes:
        return Models([])
    share = F.element_at(F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, wanted / v))))), F.col("lang"))
    part = F.col("lot") / share
    sample = usable.select("lang", "text", lot.alias("lot")).where(F.col("lot") < share)
    cut = train_docs / wanted
    untrained = [r["lang"] for r in seen if r["least"] / min(1.0, wanted / r["docs"]) >= cut]  # few documents, all for calibration by their lots
    trains = (part < cut) | F.col("lang").isin(untrained)
    counted = sample.where(trains).select("lang", "text").mapInArrow(lean(_count), "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    if counted.empty:
        return Models([])
    languages = sorted(counted["lang"].unique())
    model = kneser_ney(counted["key"].to_numpy(np.int64).view(np.uint64), np.searchsorted(languages, counted["lang"]), counted["n"].to_numpy(np.int64), languages)
    held = sample.where(~trains & F.col("lang").isin(languages)).select("lang", "text")
    found = held.mapInArrow(lean(_scored(docs.sparkSession.sparkContext.broadcast(model))), "lang string, n bigint, h array<double>").collect()
    if not found:
        return model
    return _fitted(model, np.array([r["h"] for r in found]), np.array([r["n"] for r in found]), np.array([languages.index(r["lang"]) for r in found]))


def _predict(model):
    def run(batches):
        for b in batches:
            text = b.column(b.num_columns - 1)
            for part in _slices(text):
                own = b.slice(*part)
                langs, score, rejected = decide(model.value, own.column(own.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], [*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    return run


def _slices(text: pa.Array, most: int = 2 << 20):
    """(start, length) of slices of about ``most`` bytes, at least a row each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        step = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 8192]), most)))
        yield at, min(step, len(sizes) - at)
        at += step


def predict(docs: DataFrame, model: Models, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each document, with lang_pred, score and rejected, from the text alone.

    Null texts and texts without a letter are ``und``, with score 0, and rejected. Repeated rows are judged alike; an empty table gives an empty
    result; without anything to learn from all is ``und``. Texts are scored whole, in a memory of a few MB or one text.
    """
    from pyspark.sql import types as T

    sent = docs.sparkSession.sparkContext.broadcast(model)  # the n-grams of the bounded sample
    rows = columns_free_of(docs, [*keep, "text"])
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(lean(_predict(sent)), schema)


def op7_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; three in four, by their ids, may be learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = ascii_crc_bucket(F.col("doc_id"), 4) == 2
    out = predict(docs, fit(docs.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, with all columns, that are not rejected."""
    held = ascii_crc_bucket(F.col("doc_id"), 4) == 2
    model = fit(columns_free_of(docs, ["doc_id", "text", "lang"]).where(~held))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text") if "text" in names else [n.lower() for n in names].index("text")
    placed = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches):
        for b in batches:
            for start, length in _slices(b.column(at)):
                own = b.slice(start, length)
                rejected = decide(sent.value, own.column(at).to_pylist())[2]
                yield own.filter(pa.array(~rejected))

    return placed.mapInArrow(lean(run), placed.schema).toDF(*names)
