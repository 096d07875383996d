"""A class-based bigram model: exchange clustering over word units, smoothed transitions and emissions.

Texts are stored in shards: each shard numbers its own words, so the text is read once and afterwards only numbers
move. The shards' dictionaries are joined with the corpus counts on the word (a 64-bit hash of its bytes) and come back
to their shard; nothing of the vocabulary's size is collected or broadcast.

Classes are learnt in two steps. UNITS word units (the most frequent words one by one, every other word by its ending)
give a bigram table of fixed size, which is added up by Spark; the exchange algorithm moves units between classes until
no move raises the likelihood of the class bigrams (or SWEEPS are over). Then every other training word gets the class
of its own contexts: its counts after and before each class are added up by Spark in buckets of words, each word takes
the class in which they are likeliest, the classes' statistics follow, and so on until the likelihood settles. Only
words unseen in training are classed by their ending. The end of a text is a unit and a class of its own.

The neighbours in a word's contexts keep the class of their unit while words are classed; the transitions of the model
are counted anew from the final classes of all words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayprint.llm.hashing import Words, mixed
from dayprint.llm.store import batches_of, stored
from dayprint.llm.words import chunks

#: Units: the end of a text, word endings, and the most frequent words.
ENDINGS, FREQUENT = 128, 895
UNITS = 1 + ENDINGS + FREQUENT
CLASSES = 48
SWEEPS = 30
#: Rounds of classing words by their contexts; they end when a round gains less than this share of the likelihood.
ROUNDS, SETTLED = 10, 1e-3
#: Words of a bucket and of a stored piece of one, and contexts that a task gathers before it adds them up.
BUCKET_WORDS, PIECE_WORDS, GATHERED = 40_000, 20_000, 1_000_000
#: Weight of the class frequencies behind the class bigrams, and the count taken from each word for unknown ones.
PRIOR, DISCOUNT = 20.0, 0.5
#: Text bytes of a shard.
SHARD_BYTES = 8 << 20
#: Bytes of the rows that a reader of shards and contexts holds at once; a row has megabytes.
WIDE_BYTES = 32 << 20
END = np.int64(-1)
#: Count and class travel as count * PACK + class; unknown words have CLASSES + ending in its place.
PACK = 256


def _shards(batches):
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for piece in chunks(batch, "text", SHARD_BYTES):
            words = Words(piece.column("text"), lower=True)
            h = words.hashes().view(np.int64).copy()
            h[h == END] = 0  # -1 stands for the end of a text
            two = np.where(words.ends - words.starts > 1, words.raw[np.maximum(words.ends - 2, 0)] if len(h) else 0, 0).astype(np.uint64)
            last = words.raw[words.ends - 1].astype(np.uint64) if len(h) else np.zeros(0, np.uint64)
            ending = (mixed(two * np.uint64(257) + last + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.uint8)
            local, names = pd.factorize(h)
            ids = np.zeros(len(h) + len(words.n), "<u4")
            stop = np.cumsum(words.n + 1) - 1
            body = np.ones(len(ids), bool)
            body[stop] = False
            ids[body] = local + 1  # 0 is the end
            endings = np.zeros(len(names) + 1, np.uint8)
            endings[local + 1] = ending
            held = piece.column("held_out").to_numpy(zero_copy_only=False)
            train = np.repeat(~held, words.n + 1)
            counts = np.bincount(ids[train], minlength=len(names) + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 24) + number], pa.int64()),
                    pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([held.tolist()], pa.list_(pa.bool_())),
                    pa.array([(words.n + 1).tolist()], pa.list_(pa.int32())),
                    pa.array([ids.tobytes()], pa.binary()),
                    pa.array([np.concatenate([[END], names])], pa.list_(pa.int64())),
                    pa.array([endings.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([counts], pa.list_(pa.int64())),
                ],
                ["shard", "doc_ids", "held", "lengths", "ids", "words", "endings", "counts"],
            )
            number += 1


def _units(words: np.ndarray, endings: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The unit of each word; `frequent` is sorted."""
    at = np.minimum(np.searchsorted(frequent, words), max(len(frequent) - 1, 0))
    named = frequent[at] == words if len(frequent) else np.zeros(len(words), bool)
    units = np.where(named, 1 + ENDINGS + at, 1 + endings)
    units[words == END] = 0
    return units


def _bigrams(frequent):
    def run(batches):
        total = np.zeros(UNITS * UNITS, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[k].as_py(), "<u4")
                words, endings, held, lengths = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("words", "endings", "held", "lengths"))
                units = _units(words, endings, frequent.value)[ids]
                before = np.concatenate([[0], units[:-1]])  # a text follows the end of another
                train = np.repeat(~held.astype(bool), lengths)
                total += np.bincount(before[train] * UNITS + units[train], minlength=len(total))
        rows = total.reshape(UNITS, UNITS)
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([rows[r].astype("<i8").tobytes() for r in some], pa.binary())], ["unit", "row"])

    return run


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(r, "<i8") for r in group["row"])
    return pd.DataFrame({"unit": [group["unit"].iloc[0]], "row": [total.tobytes()]})


def exchange(n: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit: unit 0 alone in class 0, the others moved one by one to where the bigram likelihood is greatest.

    n[a, b] counts b after a. The likelihood of the class bigrams, but for a constant, is the sum of
    f(N(g, h)) - f(N(g)) - f(N(h)) over classes with f(x) = x log x.
    """
    f = lambda x: x * np.log(np.maximum(x, 1))
    units = len(n)
    n = n.astype(np.float64)
    weight = n.sum(0) + n.sum(1)
    own = np.zeros(units, int)
    order = np.argsort(-weight[1:], kind="stable") + 1
    own[order] = 1 + np.arange(units - 1) % (classes - 1)
    member = np.eye(classes)[own]
    after, before = n @ member, n.T @ member  # [unit, class]
    table = member.T @ after
    for _ in range(sweeps):
        moved = False
        for u in order:
            if not weight[u]:
                continue
            a, g, self_n = own[u], np.arange(classes), n[u, u]
            out, back = after[u].copy(), before[u].copy()
            # the unit is taken out of its class
            out[a] -= self_n
            back[a] -= self_n
            t = table.copy()
            t[a, :] -= out
            t[:, a] -= back
            t[a, a] -= self_n
            rows, cols = t.sum(1), t.sum(0)
            # gain of adding it to class g: changes in row g, in column g, at their crossing, and in the margins
            gain = (f(t + out[None, :]) - f(t)).sum(1) + (f(t + back[:, None]) - f(t)).sum(0)
            d = t[g, g]
            gain += f(d + out + back + self_n) - f(d + out) - f(d + back) + f(d)
            # the other classes' margins get back what leads to it and from it wherever it goes
            rows, cols = rows + back, cols + out
            gain -= f(rows + out.sum() + self_n) - f(rows) + f(cols + back.sum() + self_n) - f(cols)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-6:
                b = a
            t[b, :] += out
            t[:, b] += back
            t[b, b] += self_n
            if b != a:
                moved = True
                own[u] = b
                after[:, a] -= n[:, u]
                after[:, b] += n[:, u]
                before[:, a] -= n[u]
                before[:, b] += n[u]
                table = t
        if not moved:
            break
    return own


CONTEXTS = "bucket int, words binary, sizes binary, codes binary, counts binary"


def _rows(bucket: int, words: np.ndarray, word: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row of a bucket: `word` numbers each context's word in ascending order."""
    sizes = np.bincount(word, minlength=len(words)).astype(np.uint8)
    parts = (words.astype("<i8"), sizes, codes.astype(np.uint8), counts.astype("<i8"))
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["bucket", "words", "sizes", "codes", "counts"])


def _read(batch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, number of each context's word, codes, counts of a row."""
    words, sizes, codes, counts = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in (("words", "<i8"), ("sizes", "u1"), ("codes", "u1"), ("counts", "<i8")))
    return words, np.repeat(np.arange(len(words)), sizes), codes, counts


def _contexts(shared):
    """How often each word without a unit of its own follows (code: class) and precedes (CLASSES + class) each class in training."""

    def run(batches):
        frequent, unit_class, buckets = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[k].as_py(), "<u4")
                words, endings, held, lengths = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("words", "endings", "held", "lengths"))
                units = _units(words, endings, frequent)
                cls = unit_class[units][ids]
                rare = (units >= 1) & (units <= ENDINGS)
                at = np.flatnonzero(np.repeat(~held.astype(bool), lengths) & rare[ids])
                if not len(at):
                    continue
                # a text begins after the end of another, which is class 0; each word is followed by one or by an end
                before = np.where(at > 0, cls[at - 1], 0)
                of = ids[at].astype(np.int64) * PACK
                keys, counts = np.unique(np.concatenate([of + before, of + CLASSES + cls[at + 1]]), return_counts=True)
                bucket = (mixed(words.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)[keys // PACK]
                order = np.argsort(bucket, kind="stable")
                keys, counts, bucket = keys[order], counts[order], bucket[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                for i, j in zip(cuts[:-1], cuts[1:]):
                    local, word = np.unique(keys[i:j] // PACK, return_inverse=True)
                    yield _rows(int(bucket[i]), words[local], word, keys[i:j] % PACK, counts[i:j])

    return run


def _added_contexts(batches):
    """The rows of each bucket added up, in pieces of PIECE_WORDS words; rows come sorted by bucket."""

    def settle(parts):
        words, keys = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        keys *= PACK
        keys += np.concatenate([p[1] for p in parts])
        order = np.argsort(keys)
        keys, counts = keys[order], np.concatenate([p[2] for p in parts])[order]
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        keys = keys[starts]
        return words[keys // PACK], (keys % PACK).astype(np.uint8), np.add.reduceat(counts, starts)

    def pieces(bucket, parts):
        own, codes, counts = settle(parts)
        words, word = np.unique(own, return_inverse=True)
        for i in range(0, len(words), PIECE_WORDS):
            a, b = np.searchsorted(word, [i, i + PIECE_WORDS])
            yield _rows(bucket, words[i : i + PIECE_WORDS], word[a:b] - i, codes[a:b], counts[a:b])

    now, parts, limit = None, [], GATHERED
    for batch in batches:
        for k, bucket in enumerate(batch.column("bucket").to_pylist()):
            if bucket != now:
                if parts:
                    yield from pieces(now, parts)
                now, parts, limit = bucket, [], GATHERED
            words, word, codes, counts = _read(batch, k)
            parts.append((words[word], codes, counts))
            if sum(len(p[1]) for p in parts) > limit:
                parts = [settle(parts)]
                limit = max(GATHERED, 2 * len(parts[0][1]))
    if parts:
        yield from pieces(now, parts)


def context_weights(follows: np.ndarray, precedes: np.ndarray) -> np.ndarray:
    """w[code, g]: the log likelihood that one context adds to a word's being in class g.

    follows[h, g] counts words of class g after class h, precedes[g, h] before it. A word of class g has P(g | h) / N(g)
    after h, and class h follows it with P(h | g).
    """
    a, b = follows + 0.5, precedes + 0.5
    after = np.log(a / a.sum(1)[:, None]) - np.log(a.sum(0))[None, :]
    w = np.concatenate([after, np.log(b / b.sum(1)[:, None]).T])
    w[:, 0] = -np.inf  # the end of a text stays alone
    return w


def _table(batch, k: int) -> tuple[np.ndarray, np.ndarray]:
    words, word, codes, counts = _read(batch, k)
    wide = 2 * CLASSES
    return words, np.bincount(word * wide + codes, counts, len(words) * wide).reshape(len(words), wide)


def _best(table: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    score = table @ w[:, 1:]
    return score.argmax(1) + 1, float(score.max(1).sum())


def _class_sums(shared):
    """For each class its contexts, number of words and their likelihood, as rows."""

    def run(batches):
        total = np.zeros((CLASSES, 2 * CLASSES + 2))
        for batch in batches:
            for k in range(batch.num_rows):
                _, table = _table(batch, k)
                best, gain = _best(table, shared.value)
                member = np.eye(CLASSES)[best]
                total[:, : 2 * CLASSES] += member.T @ table
                total[:, -2] += member.sum(0)
                total[0, -1] += gain
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int64()), pa.array([r.tobytes() for r in total.astype("<f8")], pa.binary())], ["unit", "row"])

    return run


def _added_floats(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(r, "<f8") for r in group["row"])
    return pd.DataFrame({"unit": [group["unit"].iloc[0]], "row": [total.tobytes()]})


def _classed(shared):
    """(word, code) of each word."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                words, table = _table(batch, k)
                code = table[:, :CLASSES].sum(1).astype(np.int64) * PACK + _best(table, shared.value)[0]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(code, pa.int64())], ["word", "code"])

    return run


@dataclass
class Model:
    ending_class: np.ndarray
    class_count: np.ndarray
    class_words: np.ndarray
    total: int
    distinct: int

    def emission(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P(word | class).

        What is taken from a class's words is left for unknown ones, shared by as many unseen words as were seen there.
        """
        n, v = self.class_count[cls], self.class_words[cls]
        known = np.maximum(count - DISCOUNT, DISCOUNT) / (n + 1)
        return np.log10(np.where(count > 0, known, (DISCOUNT * v + 1) / (n + 1) / (v + 1)))


def transitions(pairs: np.ndarray, count: np.ndarray) -> np.ndarray:
    """log10 P(class | class before) from the counted pairs, smoothed by the classes' own counts."""
    share = (count + 1) / (count.sum() + CLASSES)
    return np.log10((pairs + PRIOR * share[None, :]) / (pairs.sum(1)[:, None] + PRIOR))


def _emitted(shared):
    def run(shard: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        out = []
        # one shard and its words; pos is a word's number in the shard
        for row in shard.itertuples():
            words = words.sort_values("pos")
            code = words["code"].to_numpy()
            tag, count = code % PACK, code // PACK
            cls = np.where(tag < CLASSES, tag, m.ending_class[np.maximum(tag - CLASSES, 0)])
            # the end of a text is the only word of its class
            emit = np.where(tag == 0, 0.0, m.emission(count, cls))
            plain = np.log10((count + 1) / (m.total + m.distinct + 1))
            ids = np.frombuffer(row.ids, "<u4")
            k = cls.astype(np.uint8)[ids]
            ends = np.cumsum(row.lengths)
            starts = ends - row.lengths
            add = lambda x: np.add.reduceat(x, starts)
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array(row.doc_ids, "Int64"), "held_out": row.held, "n_tokens": row.lengths.astype(np.int64),
                        "n_known": add((count > 0).astype(np.int64)[ids]), "train_tokens": m.total,
                        "base_score": add(plain[ids]), "emitted": add(emit[ids]), "classes": [k[a:b].tobytes() for a, b in zip(starts, ends)],
                    }
                )
            )
        return pd.concat(out)

    return run


def _class_pairs(batches):
    total = np.zeros((CLASSES, CLASSES), np.int64)
    for batch in batches:
        for classes, held in zip(batch.column("classes"), batch.column("held_out").to_pylist()):
            if not held:
                k = np.frombuffer(classes.as_py(), np.uint8).astype(np.int64)
                total += np.bincount(np.concatenate([[0], k[:-1]]) * CLASSES + k, minlength=total.size).reshape(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int64()), pa.array([r.astype("<i8").tobytes() for r in total], pa.binary())], ["unit", "row"])


def _scored(shared):
    def run(batches):
        for batch in batches:
            moved = []
            for classes in batch.column("classes"):
                k = np.frombuffer(classes.as_py(), np.uint8)
                moved.append(shared.value[np.concatenate([[0], k[:-1]]), k].sum())
            score = batch.column("emitted").to_numpy() + np.array(moved, np.float64)
            kept = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score, pa.float64())], [*kept, "score"])

    return run


def _collected(rows: DataFrame, shape: tuple[int, int], kind: str) -> np.ndarray:
    """The table that (unit, row) rows add up to; it has as many rows as units or classes."""
    add = _added if kind == "<i8" else _added_floats
    out = np.zeros(shape, kind)
    for r in rows.groupBy("unit").applyInPandas(add, "unit long, row binary").collect():
        out[r["unit"]] = np.frombuffer(r["row"], kind)
    return out


def _context_classes(contexts: DataFrame, n: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights that class the words of `contexts`, and count and number of words of each class, frequent words included."""
    spark = contexts.sparkSession
    member = np.eye(CLASSES)[own]
    named = np.r_[0, 1 + ENDINGS : UNITS]
    follows = member.T @ n[:, named] @ member[named]
    precedes = member[named].T @ n[named] @ member
    words = (n.sum(0)[named] > 0) @ member[named]
    weights, before = context_weights(member.T @ n @ member, member.T @ n @ member), None
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(weights)
        sums = _collected(contexts.mapInArrow(_class_sums(shared), "unit long, row binary"), (CLASSES, 2 * CLASSES + 2), "<f8")
        after, ahead, gain = sums[:, :CLASSES], sums[:, CLASSES:-2], sums[0, -1]
        a, b = follows + after.T, precedes + ahead
        if before is not None and gain - before <= SETTLED * abs(before):
            break
        before, used, weights = gain, weights, context_weights(a, b)
        counted = a.sum(0), words + sums[:, -2]
    return used, *counted


def scored(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of (doc_id, text).

    The model learns from rows whose crc32(doc_id as text) mod `folds` is not `fold`. A-Z are lower-cased, words end at
    white space, each text ends with one more token. Null and empty texts are that token alone; repeated rows count as
    often as they occur; a null doc_id counts as an empty one; an empty table gives an empty result; further columns
    are ignored.
    """
    with batches_of(docs.sparkSession, WIDE_BYTES):
        return _scored_texts(docs, folds, fold)


def _scored_texts(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.pmod(crc, F.lit(folds)) == fold).alias("held_out"))
    schema = "shard long, doc_ids array<long>, held array<boolean>, lengths array<int>, ids binary, words array<long>, endings array<int>, counts array<long>"
    shards = stored(rows.mapInArrow(_shards, schema), "shards", group_bytes=WIDE_BYTES)
    entries = shards.select("shard", F.posexplode(F.arrays_zip("words", "endings", "counts")).alias("pos", "e"))
    entries = entries.select("shard", "pos", F.col("e.words").alias("word"), F.col("e.endings").alias("ending"), F.col("e.counts").alias("n"))
    vocabulary = stored(entries.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n")).where("n > 0"), "vocabulary")
    top = vocabulary.where(F.col("word") != int(END)).orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").collect()
    frequent = np.sort(np.array([r["word"] for r in top], np.int64))
    shared = spark.sparkContext.broadcast(frequent)
    seen = shards.select("ids", "words", "endings", "held", "lengths")
    n = _collected(seen.mapInArrow(_bigrams(shared), "unit long, row binary"), (UNITS, UNITS), "<i8")
    own = exchange(n, CLASSES)
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, -(-distinct // BUCKET_WORDS))
    shared = spark.sparkContext.broadcast((frequent, own, buckets))
    contexts = seen.mapInArrow(_contexts(shared), CONTEXTS).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    contexts = stored(contexts.mapInArrow(_added_contexts, CONTEXTS), "contexts", group_bytes=WIDE_BYTES)
    weights, count, words = _context_classes(contexts, n, own)
    # the places of words move narrow: place and ending in one number, count and class in another
    units = [0, *range(1 + ENDINGS, 1 + ENDINGS + len(frequent))]
    named = spark.createDataFrame([(int(w), int(n[:, u].sum()) * PACK + int(own[u])) for w, u in zip([END, *frequent], units) if n[:, u].sum()], "word long, code long")
    coded = contexts.mapInArrow(_classed(spark.sparkContext.broadcast(weights)), "word long, code long").union(named)
    places = entries.select("word", "shard", (F.col("pos").cast("long") * ENDINGS + F.col("ending")).alias("place"))
    code = F.coalesce("code", F.col("place") % ENDINGS + CLASSES)
    counted = places.join(coded, "word", "left").select("shard", F.floor(F.col("place") / ENDINGS).cast("int").alias("pos"), code.alias("code"))
    texts = shards.select(F.col("shard").alias("own_shard"), "doc_ids", "held", "lengths", "ids")
    model = spark.sparkContext.broadcast(Model(own[1 : 1 + ENDINGS], count, words, total, distinct))
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double"
    emitted = texts.groupBy("own_shard").cogroup(counted.groupBy("shard")).applyInPandas(_emitted(model), result + ", emitted double, classes binary")
    emitted = stored(emitted, "emitted")
    pairs = _collected(emitted.select("classes", "held_out").mapInArrow(_class_pairs, "unit long, row binary"), (CLASSES, CLASSES), "<i8")
    moves = spark.sparkContext.broadcast(transitions(pairs, count))
    return emitted.mapInArrow(_scored(moves), result + ", score double")
