"""N-gram Jaccard self-join: MinHash bands propose, full n-gram sets decide.

Texts with the same words form a class at once, so groups of copies cost one row each. Band hashes of the classes are
shuffled; classes that meet in a band are linked to the least one of that band (linear in the group's size), and the
components of these links are what is verified. A component is cut into blocks by the volume of its n-gram sets; each
pair of blocks is one piece of work, in which every pair that shares a band is compared on its full sets. What leaves a
piece is a count per text and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayprint.llm.components import components
from dayprint.llm.hashing import CHUNK_BYTES, Words, mixed, windows
from dayprint.llm.store import sized, stored
from dayprint.llm.words import chunks, give_back

#: Volume of a block: n-grams plus MEMBER for each text, so that a pair of blocks has fewer than a thousand texts.
BLOCK = 120_000
MEMBER = 256


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding with at most `most` hashes that finds pairs at the threshold with this recall."""
    best = None
    for rows in range(1, most + 1):
        missed = math.log1p(-(threshold**rows)) if threshold < 1 else -math.inf
        if not missed or -math.log(1 - recall) > -missed * most:
            break
        bands = max(1, math.ceil(math.log(1 - recall) / missed))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding within this many hashes reaches the recall")
    return best


def ngram_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts one after the other, and how many each has.

    A text with fewer words than an n-gram has one n-gram of all its words; a text without words has none.
    """
    h = words.hashes()
    n = np.where(words.n >= width, words.n - width + 1, np.minimum(words.n, 1))
    doc = np.repeat(np.arange(len(n)), n)
    at = words.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    grams = np.zeros(len(doc), np.uint64)
    short = words.n[doc] < width
    full = windows(h, width)
    grams[~short] = full[at[~short]]
    for i in np.flatnonzero(short):
        part = h[at[i] : at[i] + words.n[doc[i]]]
        grams[i] = windows(part, len(part))[0] ^ np.uint64(len(part))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[fresh], np.bincount(doc[fresh], minlength=len(n))


def band_hashes(grams: np.ndarray, n: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """One hash for each text with n-grams and each band."""
    draw = np.random.default_rng(seed)
    flips = draw.integers(0, 1 << 63, bands * rows, np.uint64)
    factors = draw.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    n = n[n > 0]
    starts = np.cumsum(n) - n
    out = np.empty((len(n), bands), np.uint64)
    # stretches of texts that stay in the processor's cache
    cuts = [0, *np.searchsorted(starts, np.arange(65_536, len(grams), 65_536)).tolist(), len(n)]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        part = grams[starts[a] : starts[b - 1] + n[b - 1]]
        first = starts[a:b] - starts[a]
        for band in range(bands):
            h = np.full(b - a, band, np.uint64)
            for k in range(band * rows, (band + 1) * rows):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((part ^ flips[k]) * factors[k], first))
            out[a:b, band] = h
    return out


def _digests(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's words in order."""
    out = []
    for salt in (0, 0x632BE59BD9B4E019):
        h = mixed(words.hashes() ^ np.uint64(salt))
        place = np.arange(len(h)) - np.repeat(words.first, words.n)
        h = mixed(h + mixed(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
        out.append((sums[words.first + words.n] - sums[words.first]).view(np.int64))
    return out[0], out[1]


def _signatures(width: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for piece in chunks(batch, "text", CHUNK_BYTES):
                words = Words(piece.column("text"))
                grams, n = ngram_sets(words, width)
                has = n > 0
                hashes = band_hashes(grams, n, bands, rows).view(np.int64)
                flat = pa.array(hashes.reshape(-1))
                offsets = pa.array(np.concatenate([[0], np.cumsum(has * bands)]), pa.int32())
                one, two = _digests(words)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").cast(pa.int64()), pa.array(one), pa.array(two), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                    ["doc_id", "digest", "digest2", "n_grams", "bands"],
                )

    return run


def _sets(width: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for piece in chunks(batch, "text", CHUNK_BYTES):
                words = Words(piece.column("text"))
                one, two = _digests(words)
                # another text under the same doc_id is no member
                mine = (one == piece.column("digest").to_numpy()) & (two == piece.column("digest2").to_numpy())
                grams, n = ngram_sets(words, width)
                hashes = band_hashes(grams, n, bands, rows)
                full = np.cumsum(n > 0) - 1
                ends = np.cumsum(n)
                keep = np.flatnonzero(mine & (n > 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(piece.column(c).take(pa.array(keep)) for c in ("rep", "copies", "component", "blocks", "block")),
                        pa.array([grams[ends[i] - n[i] : ends[i]].tobytes() for i in keep], pa.binary()),
                        pa.array([hashes[full[i]].tobytes() for i in keep], pa.binary()),
                    ],
                    ["rep", "copies", "component", "blocks", "block", "grams", "bands"],
                )

    return run


def _common(sets: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the wanted pairs of sets; other entries may be anything."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    pairs = np.argwhere(np.triu(wanted, 1))
    flat = np.concatenate(sets)
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    out = np.zeros((m, m), np.float32)
    if m * m * len(shared) * 0.05 < len(pairs) * (sizes.mean() * 40 + 8000):
        column = np.full(len(values), -1)
        column[shared] = np.arange(len(shared))
        column, doc = column[inverse], np.repeat(np.arange(m), sizes)
        doc, column = doc[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        doc, column = doc[order], column[order]
        width = 2048
        for at in range(0, len(shared), width):
            a, b = np.searchsorted(column, [at, at + width])
            grid = np.zeros((m, width), np.float32)
            grid[doc[a:b], column[a:b] - at] = 1
            out += grid @ grid.T
    else:
        for i, j in pairs:
            out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    return out


def linked(sets: list[np.ndarray], bands: np.ndarray, block: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, among those that share a band and that this piece of work is for."""
    m = len(sets)
    share = np.zeros((m, m), bool)
    for band in bands.T:
        share |= band[:, None] == band[None, :]
    if len(np.unique(block)) > 1:
        share &= block[:, None] != block[None, :]
    sizes = np.array([len(s) for s in sets], np.int64)
    share &= np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes)
    np.fill_diagonal(share, False)
    if not share.any():
        return share
    common = _common(sets, share).astype(np.float64)
    return share & (common / (np.add.outer(sizes, sizes) - common) >= threshold)


def _least_labels(links: np.ndarray) -> np.ndarray:
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in group.groupby(["component", "p", "q"], sort=False):
            part = part.drop_duplicates("rep").sort_values("rep")
            if len(part) < 2 or part["p"].iloc[0] != part["q"].iloc[0] and part["block"].nunique() < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in part["grams"]]
            bands = np.stack([np.frombuffer(x, np.uint64) for x in part["bands"]])
            links = linked(sets, bands, part["block"].to_numpy(), threshold)
            reps = part["rep"].to_numpy()
            out.append(pd.DataFrame({"rep": reps, "other": reps[_least_labels(links)], "n_links": links @ part["copies"].to_numpy()}))
        give_back()
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "other": [], "n_links": []}, dtype="int64")

    return run


def _named(classes: DataFrame) -> DataFrame:
    """Classes (digest, digest2, least, ...) with a name `rep` of their own.

    The name is the class's least doc_id. Where one doc_id has several texts, the text of the least digest keeps it and
    the others are named by a hash of their digests.
    """
    several = classes.groupBy("least").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("digest", "digest2")).alias("first")).where("n > 1")
    several = sized(stored(several.select(F.col("least").alias("of"), "first"), "repeated"), 32)
    own = F.col("first").isNull() | (F.struct("digest", "digest2") == F.col("first"))
    name = F.when(own, F.col("least")).otherwise(F.xxhash64("digest", "digest2")).alias("rep")
    return classes.join(several, F.col("least") == F.col("of"), "left").select(*classes.columns, name)


def similar(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9999) -> DataFrame:
    """doc_id, class_id, n_links of every row of (doc_id, text): its class's least doc_id, and the other rows it is linked to.

    Rows are linked if the sets of their `width`-word n-grams have a Jaccard similarity of at least `threshold`; pairs
    below it never are, and those at it are found with probability `recall` or more. Words end at white space, case and
    signs count. Texts without words (null, empty) link with nothing; shorter texts count as one n-gram. Rows with the
    same words are linked; different texts under one doc_id are classes of their own, both named by it; a null doc_id links with nothing; further
    columns are ignored; an empty table gives an empty result.
    """
    bands, rows = bands_for(threshold, recall)
    schema = "doc_id long, digest long, digest2 long, n_grams long, bands array<long>"
    signs = stored(docs.select("doc_id", "text").mapInArrow(_signatures(width, bands, rows), schema), "signatures")
    full = signs.where("n_grams > 0 and doc_id is not null")
    classes = stored(
        full.groupBy("digest", "digest2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")),
        "classes",
    )
    classes = stored(_named(classes), "named")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    met = banded.groupBy("band").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    meetings = banded.join(met, "band").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    proposed = stored(components(meetings), "proposed")
    members = classes.drop("bands").join(proposed, F.col("rep") == F.col("node")).drop("node")
    volume = members.groupBy("component").agg(F.ceil(F.sum(F.col("n_grams") + MEMBER) / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")
    members = stored(members.join(volume, "component").select("rep", "least", "copies", "component", "blocks", "digest", "digest2", block), "members")
    chosen = docs.select(F.col("doc_id").alias("least"), "text").join(sized(members, 72), "least")
    carried = chosen.select("text", "rep", "copies", "component", "blocks", "block", "digest", "digest2")
    sets = carried.mapInArrow(_sets(width, bands, rows), "rep long, copies long, component long, blocks int, block int, grams binary, bands binary")
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # small components share a group, so that there are about as many groups as blocks' worth of work
    total = members.agg(F.count(F.lit(1))).first()[0]
    shares = max(16, total // 256)
    key = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(shares))).otherwise(F.xxhash64("component", "p", "q"))
    pairs = pairs.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).withColumn("piece", key)
    found = stored(pairs.groupBy("piece").applyInPandas(_verified(threshold), "rep long, other long, n_links long"), "links")
    joined = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    # the least doc_id of each component: its name may be a text's hash
    joined = stored(joined.join(members.select("rep", "least").distinct(), F.col("rep") == F.col("node")).select("node", "component", "least"), "joined")
    joined = joined.join(joined.groupBy("component").agg(F.min("least").alias("class_id")), "component").select("node", "class_id")
    named = classes.select("digest", "digest2", "rep", "least", "copies").join(links, "rep", "left")
    named = named.join(joined, F.col("rep") == F.col("node"), "left").select(
        "digest", "digest2", F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    alone = signs.where("n_grams = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return full.select("doc_id", "digest", "digest2").join(named, ["digest", "digest2"]).select("doc_id", "class_id", "n_links").union(alone)


def representatives(docs: DataFrame, **settings) -> DataFrame:
    """The documents whose doc_id is the least of their class, with their own columns.

    Of repeated rows one stays; documents without words and rows with a null doc_id stay.
    """
    first = similar(docs, **settings).where("doc_id = class_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    first = stored(first, "kept")
    kept = docs.join(sized(first.select("doc_id"), 16), "doc_id", "left_semi")
    if first.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)
