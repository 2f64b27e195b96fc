"""SimHash near-dedup: fingerprints of word shingles, linked by a self-join of their binary trie. The pipeline's stage
takes the same links as candidates, adds those of MinHash bands, which reach further than a few bits, and verifies each exactly."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.common import MAX_BROADCAST_IDS, SHORT, components, cut, digest_of, keep_rows, map_rows, release, text_of

#: Depths at which the trie is visited: where nodes may have many children, and below, where nearly all have one.
DENSE, SPARSE = (8, 12, 16, 20, 24, 28, 32), (48, 64)
#: Depths behind which the pipeline's stage writes the pairs: the driver holds the plan and the tasks of a few depths only, beside all it has from the stages before.
HALTS = (16, 24, 32, 48)


#: MinHash bands and the minima of each: two sets with similarity 0.8 share no band with probability 7e-5, with 0.9 less than 1e-9.
BANDS, MINIMA = 24, 5
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Rows of a band from which they meet its ends only, not their neighbours, before the components are known.
HEAVY = 500
#: Nodes of a band up to which its pairs are rows of their own, nodes of a block of a larger one, and shingles of a table.
FEW, BLOCK, COLUMNS = 24, 256, 4096
#: Shingle hashes that a task keeps for the next pairs, 8 bytes each.
HELD = 2_000_000


def hashes_of(text: str, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles, in order. A-Z are lower-cased, words are split at ASCII white space. Fewer words than
    a shingle: one shingle of all words; no words: none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and bytes.split know ASCII only
    parts = ([words] if words else []) if len(words) < shingle else zip(*[words[k:] for k in range(shingle)])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(p), 42) for p in parts], dtype="<u8")


def fingerprint(text: str, shingle: int) -> int:
    """64 bits: bit j is 1 if it is set in over half of the hashes of the shingles; no words: 0."""
    return majority(hashes_of(text, shingle))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row of docs; a null text counts as empty."""

    def work(batches):
        for batch in batches:
            values = [fingerprint(t, shingle) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": np.array(values, dtype=np.uint64).view(np.int64)})
        release()

    return map_rows(docs.select("doc_id", text_of().alias("text")), work, "fp long")


def flips(width: int, budget: int) -> list[int]:
    """Bit patterns of `width` bits with at most `budget` ones."""
    return [sum(1 << i for i in c) for k in range(budget + 1) for c in combinations(range(width), k)]


def trie_pairs(values: DataFrame, budget: int = 2, halts: tuple[int, ...] = ()) -> DataFrame:
    """Pairs (a, b) with a < b of the distinct 64-bit values `fp` that differ in at most `budget` bits.

    Binary trie self-join. A row is a pair of nodes of one depth and the bits they differ in so
    far; chains of single bits between two depths are walked in one step. Down to 32 bits each child of the left node
    asks, by prefix, only for the right node's children that the left budget still allows. Below, where nearly every node has
    one child, the children of both nodes meet and pairs over the budget are pruned. Every step is an equi-join on prefixes. The
    widest depth has about as many pairs as there are values, times the patterns of `budget` flips. Behind the depths `halts` the pairs
    are written, so that a plan has the depths between two of them."""
    pairs, last = None, 0
    for depth in (*DENSE, *SPARSE):
        step = depth - last
        nodes = values.select(F.shiftrightunsigned("fp", 64 - depth).alias("node")).distinct() if depth < 64 else values.select(F.col("fp").alias("node"))
        up = F.shiftrightunsigned("node", step) if depth > step else F.lit(0).cast("long")
        left = nodes.select(F.col("node").alias("a"), up.alias("a_up"))
        left = left.select("a", F.lit(0).cast("long").alias("b_up"), F.lit(0).alias("used")) if pairs is None else pairs.select(F.col("a").alias("a_up"), F.col("b").alias("b_up"), "used").join(left, "a_up").select("a", "b_up", "used")
        # of the mirrored pairs one is kept; a node with itself stays, for the pairs inside it
        ordered = (F.col("a") <= F.col("b")) if depth < 64 else (F.col("a") != F.col("b"))
        if depth in DENSE:
            allowed = None
            for used in reversed(range(budget + 1)):
                masks = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("bits")) for m in flips(step, budget - used)])
                allowed = masks if allowed is None else F.when(F.col("used") == used, masks).otherwise(allowed)
            low = F.lit((1 << step) - 1).cast("long")
            moved = left.select("a", "b_up", "used", F.explode(allowed).alias("flip"))
            wanted = moved.select("a", (F.col("used") + F.col("flip.bits")).alias("used"), F.shiftleft("b_up", step).bitwiseOR(F.col("a").bitwiseAND(low).bitwiseXOR(F.col("flip.mask"))).alias("b"))
            pairs = wanted.where(ordered).join(nodes.select(F.col("node").alias("b")), "b").select("a", "b", "used")
        else:
            right = nodes.select(F.col("node").alias("b"), up.alias("b_up"))
            # the bits above differ in `used` places: those of the whole prefix are used + the new ones
            near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= budget) & ordered
            pairs = left.alias("l").join(right.alias("r"), (F.col("l.b_up") == F.col("r.b_up")) & near).select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("used"))
        if depth in halts:
            pairs = cut(pairs, "trie", SHORT)
        last = depth
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): doc_id, fingerprint
    (16 hex digits), component_id (the smallest doc_id reachable over links, itself included), links
    (other distinct fingerprints linked directly).

    Rows with one fingerprint form a class at once; only distinct fingerprints meet in the trie, and components are those of
    fingerprints, so a group of copies is one trie leaf however large it is. A row without a doc_id links like any other, but gives
    no name: its component_id is the smallest doc_id of the others, null where there is none. Rows that repeat a doc_id with other texts are
    rows of their own: each has the component of its own fingerprint. A null or empty text, or one of white space, has fingerprint 0. An
    empty table gives no rows. doc_id may be of any type that has an order."""
    marks = cut(fingerprints(docs, shingle), "fingerprints")
    classes = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    pairs = cut(trie_pairs(classes, budget), "pairs", SHORT)
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("links"))
    found = components(pairs)
    linked = cut(classes.join(found, classes["fp"] == found["node"]).select("fp", "first", "component"), "linked", SHORT)
    names = linked.groupBy("component").agg(F.min("first").alias("least"))
    linked = linked.join(names, "component").select("fp", "least").join(ends, "fp")
    labelled = classes.join(linked, "fp", "left").select("fp", F.when(F.col("links").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return marks.join(labelled, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


def band_keys(own: np.ndarray) -> list[int]:
    """A key for each band of the distinct hashes `own`: that of the minima under MINIMA of the multiplications."""
    low = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(own), 2048):
        low = np.minimum(low, (own[start : start + 2048, None] * FACTORS).min(axis=0))
    return [xxhash.xxh64_intdigest(part.tobytes(), band) for band, part in enumerate(low.reshape(BANDS, MINIMA))]


def shingle_classes(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, digest, node long, fp long, bands array<long>) for every row of docs: rows with one set of shingles have one node."""

    def work(batches):
        for batch in batches:
            sets, marks = [], []
            for text in batch["text"]:
                hashes = hashes_of(text, shingle)
                sets.append(np.unique(hashes))
                marks.append(majority(hashes))
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "node": nodes, "fp": np.array(marks, dtype=np.uint64).view(np.int64), "bands": [np.array(band_keys(s), dtype=np.uint64).view(np.int64) for s in sets]})
        release()

    return map_rows(docs.select("doc_id", digest_of().alias("digest"), text_of().alias("text")), work, "digest binary, node long, fp long, bands array<long>")


def texts_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of some nodes: the text of one row of docs for each."""
    wanted = cut(classes.join(nodes.distinct(), "node", "left_semi").select("node", F.col("digest").alias("__digest")), "wanted", SHORT)
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_IDS // 8 else wanted
    # rows that repeat a text are few, and meet again here
    texts = docs.select(text_of().alias("text"), digest_of().alias("__digest")).join(wanted, "__digest").groupBy("node").agg(F.first("text").alias("text"))
    return cut(texts, "texts", 4)


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets of shingles have a Jaccard similarity of `similarity` or more."""
    texts = texts_of(docs, classes, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")

    def work(batches):
        held, size = {}, 0
        for batch in batches:
            ok = []
            for x, y, s, t in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"]):
                if size > HELD:
                    held, size = {}, 0
                for node, text in ((x, s), (y, t)):
                    if node not in held:
                        held[node] = np.unique(hashes_of(text, shingle))
                        size += len(held[node])
                n, m = len(held[x]), len(held[y])
                both = len(np.intersect1d(held[x], held[y], assume_unique=True)) if min(n, m) >= similarity * max(n, m) else 0
                ok.append(both > 0 and both >= similarity * (n + m - both))
            yield batch.loc[ok, ["a", "b"]]
        del held
        release()

    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInPandas(work, "a long, b long")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set on the left shares with each on the right (sorted, without repeats)."""
    out = np.zeros((len(left), len(right)), np.float32)
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    places = []
    for sets in (left, right):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        value = np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, value), max(len(common) - 1, 0))
        hit = common[at] == value if len(common) else np.zeros(len(value), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((row[hit][order], at[hit][order]))
    for start in range(0, len(common), COLUMNS):
        tables = []
        for (row, at), sets in zip(places, (left, right)):
            low, high = np.searchsorted(at, (start, start + COLUMNS))
            table = np.zeros((len(sets), COLUMNS), np.float32)
            table[row[low:high], at[low:high] - start] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out.astype(np.int64)


def block_links(docs: DataFrame, classes: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between different components of the bands of rows (key, node, component, main, n): every node outside a band's main
    component is compared with every other node of the band, in pairs of blocks of about BLOCK nodes, as products of tables
    of their shingles. No row is made for a pair that isn't a link, and of the links of a node with a component one is enough."""

    def hashed(batches):
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "hashes": [np.unique(hashes_of(t, shingle)).tobytes() for t in batch["text"]]})
        release()

    sets = texts_of(docs, classes, rows.select("node")).mapInPandas(hashed, "node long, hashes binary")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own, each = F.pmod(F.xxhash64("node"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    left = rows.where("component <> main").select("key", "node", "component", own.alias("i"), each.alias("j"), F.lit(True).alias("left"))
    right = rows.select("key", "node", "component", each.alias("i"), own.alias("j"), F.lit(False).alias("left"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame[frame["left"]], frame[~frame["left"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        sides = [[np.frombuffer(h, "<u8") for h in f["hashes"]] for f in (x, y)]
        sizes = [np.array([len(h) for h in s]) for s in sides]
        both = shared_counts(*sides)
        near = (both > 0) & (both >= similarity * (sizes[0][:, None] + sizes[1][None, :] - both))
        near &= x["component"].to_numpy()[:, None] != y["component"].to_numpy()[None, :]
        i, j = np.nonzero(near)
        out = pd.DataFrame({"a": x["node"].to_numpy()[i], "b": y["node"].to_numpy()[j], "to": y["component"].to_numpy()[j]})
        return out.drop_duplicates(["a", "to"])[["a", "b"]]

    return left.union(right).join(sets, "node").groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def fingerprint_pairs(classes: DataFrame, budget: int = 2) -> DataFrame:
    """(a, b): nodes of `classes` (node, fp) whose fingerprints are equal or linked in the trie. A fingerprint's first node stands for it; the
    others meet that one, so there are as many rows as nodes and links."""
    firsts = cut(classes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints", SHORT)
    linked = cut(trie_pairs(firsts, budget, HALTS), "pairs", SHORT)
    a, b = (firsts.select(F.col("fp").alias(x), F.col("first").alias(f"node_{x}")) for x in "ab")
    own = classes.join(firsts, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return own.union(linked.join(a, "a").join(b, "b").select("node_a", "node_b")).where("a <> b")


def similar_components(docs: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, component) of the nodes of `classes` (node, digest, fp, bands) that have links: pairs that share a band, or whose
    fingerprints are linked, and that are verified.

    Nodes of a band meet their next two in it, those of a very large one its first and last. In the bands that still hold
    several components afterwards, all pairs of different components meet: one by one in bands of up to FEW nodes, in blocks in
    larger ones. So of the pairs that share a band, none that could join two components is left out, and a group of copies costs rows
    in proportion to its size."""
    bands = classes.select("node", F.explode("bands").alias("key"))
    sizes = cut(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1"), "bands", SHORT)
    heavy = sizes.where(F.col("n") > HEAVY).select("key", "low", "high")
    heavy = F.broadcast(heavy) if heavy.count() <= MAX_BROADCAST_IDS // 8 else heavy
    near = Window.partitionBy("key").orderBy("node")
    light = bands.join(heavy, "key", "left_anti").select("node", F.array(F.lead("node", 1).over(near), F.lead("node", 2).over(near)).alias("next")).select("node", F.explode("next").alias("other"))
    far = bands.join(heavy, "key").select("node", F.explode(F.array("low", "high")).alias("other"))
    alike = cut(fingerprint_pairs(classes), "alike", SHORT).toDF("node", "other")
    tested = light.union(far).union(alike).where("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    tested = cut(tested, "candidates", SHORT)
    found = components(verified(docs, classes, tested, shingle, similarity))
    # bands that still hold several components
    rows = bands.join(sizes.select("key", "n"), "key").join(found, "node", "left").select("key", "n", "node", F.coalesce("component", "node").alias("component"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.mode("component").alias("main")).where("least <> most")
    rows = cut(rows.join(mixed.select("key", "main"), "key"), "mixed", SHORT)
    small = rows.where(F.col("n") <= FEW)
    x, y = small.where("component <> main").alias("x"), small.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    more = x.join(y, apart).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    more = verified(docs, classes, cut(more, "candidates", SHORT), shingle, similarity)
    blocks = block_links(docs, classes, rows.where(F.col("n") > FEW), shingle, similarity)
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more).union(blocks))


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (a null one comes last), then the smallest digest.

    Rows are linked if their sets of shingles have a Jaccard similarity of `similarity` or more, exactly computed; texts
    without words are one class. Candidates are the links of the SimHash fingerprints in their trie (2 bits), and MinHash bands for edits
    that change more bits: of a pair at 0.8, 1 - 7e-5 are expected to be seen."""
    marks = cut(shingle_classes(docs, shingle), "shingles")
    classes = cut(marks.groupBy("node").agg(F.min("digest").alias("digest"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "classes", 4)
    found = similar_components(docs, classes, shingle, similarity)
    rows = marks.select("doc_id", "digest", "node").join(found, "node", "left").select("doc_id", "digest", F.coalesce("component", "node").alias("component"))
    rows = cut(rows, "components", 4)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = rows.join(first, "component").select("doc_id", "digest", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))).alias("kept"))
    return keep_rows(docs, marked)
