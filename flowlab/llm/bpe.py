"""BPE encoding through a table of distinct words, and decoding through a join with the id-to-piece table."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.common import cut, partitions, release, text_of

#: White space but the plain space and the line feed, and the separators that only Python counts as such.
ODD = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]")
#: White space and then other characters; or white space at the end.
WORD = re.compile(r"\s*\S+|\s+")

#: Characters of a group of documents, and of the groups' texts for each bucket of the word table: more data makes more
#: groups and buckets, not larger ones.
GROUP, BUCKET = 6_000_000, 24_000_000
#: Characters that a task deals out to the groups at once, a blob for each group.
DEAL = 24_000_000

_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizers object of a vocabulary file, without truncation and padding, once per worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        _loaded[path] = own
    return _loaded[path]


def encode_batch(path: str, words: list[str]) -> list[list[int]]:
    own = tokenizer(path)
    return [e.ids for e in own.encode_batch_fast(words, add_special_tokens=False)]


def id_type(path: str) -> str:
    return "<u2" if tokenizer(path).get_vocab_size() <= 65536 else "<u4"


def piece_bytes(path: str) -> list[bytes]:
    """The id-to-piece table of a byte-level vocabulary: the bytes of each id."""
    if ("pieces", path) not in _loaded:
        own = tokenizer(path)
        # the byte alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        other = [b for b in range(256) if b not in set(plain)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        table = []
        for i in range(own.get_vocab_size()):
            piece = own.id_to_token(i) or ""
            table.append(bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode())
        _loaded[("pieces", path)] = table
    return _loaded[("pieces", path)]


def split_words(text: str) -> tuple[str, list[str] | None, list[str]]:
    """(first, rest, odd): the words of a text whose tokens don't depend on one another.

    A byte-level tokenizer never joins a visible character to the space after it, so a text may be cut
    before each space that follows one. Usual texts are cut at every single space: `first` and
    `rest` without their spaces. Otherwise rest is None, and `odd` has words with all their white space."""
    strange = text.isascii() and not any(c in text for c in "\t\x0b\x0c\r\x1c\x1d\x1e\x1f") or not ODD.search(text)
    if strange and "  " not in text and "\n " not in text:
        first, *rest = text.split(" ")
        return first, rest, []
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return "", None, [text]
    return "", None, WORD.findall(text)


def distinct_words(texts: list[str], buckets: int) -> tuple[list[list[bytes]], list]:
    """The distinct words of some texts in UTF-8, per bucket in sorted order, and the split texts."""
    split = [split_words(t) for t in texts]
    follow: set[str] = set()
    words: set[str] = set()
    for first, rest, odd in split:
        if rest is None:
            words.update(odd)
        else:
            follow.update(rest)
            words.add(first)
    words.update([" " + w for w in follow])
    words.discard("")
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    for raw in sorted(w.encode("utf-8", "surrogatepass") for w in words):
        out[zlib.crc32(raw) % buckets].append(raw)
    return out, split


def _pack(parts: list[bytes]) -> bytes:
    """Byte strings one after another, compressed, behind their lengths."""
    lengths = np.fromiter(map(len, parts), np.uint32, len(parts))
    planes = lengths.view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(parts).to_bytes(4, "little") + planes + b"".join(parts))


def _unpack(value: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n = int.from_bytes(raw[:4], "little")
    lengths = np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, n).T.copy().view(np.uint32).ravel()
    ends = np.cumsum(lengths, dtype=np.int64) + 4 + 4 * n
    return [raw[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece binary): the id-to-piece table, as many rows as the vocabulary has."""
    return spark.createDataFrame(list(enumerate(piece_bytes(path))), "id int, piece binary")


def _pieces_by_group(ids: DataFrame, path: str) -> DataFrame:
    """(grp, piece_ids, pieces) of the distinct rows (grp, id): each group's ids joined with the id-to-piece table, which is
    broadcast (its size is that of the vocabulary)."""
    joined = ids.join(F.broadcast(piece_table(ids.sparkSession, path)), "id")
    return joined.groupBy("grp").agg(F.collect_list(F.struct("id", "piece")).alias("rows")).select("grp", F.col("rows.id").alias("piece_ids"), F.col("rows.piece").alias("pieces"))


def _groups(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.char_length(text_of()))).first()[0] or 0
    return max(partitions(docs.sparkSession), 1 + size // GROUP)


def _lookup(frame: pd.DataFrame) -> list[bytes]:
    """Pieces by id, from a group's joined rows."""
    own: dict[int, bytes] = {}
    for ids, pieces in zip(frame["piece_ids"], frame["pieces"]):
        if ids is not None:
            own.update(zip(ids.tolist(), pieces))
    table = [b""] * (max(own, default=-1) + 1)
    for i, piece in own.items():
        table[i] = piece
    return table


def encode_documents(docs: DataFrame, path: str, finish, schema: str) -> DataFrame:
    """Encode whole texts with a byte-level BPE file; finish(doc_ids, ids (a list of arrays), pieces (bytes by id)) makes the
    result's frame for a group of documents; in `schema` doc_id is a string.

    Distinct-word table. Documents are dealt by a hash of doc_id and text into groups of about GROUP characters (compressed, one
    shuffle). Each group sends its distinct words to the buckets of a word table; a bucket encodes
    each of its distinct words once, for all groups; the ids, in a written table, come back to the group and are joined
    by position. The group's distinct ids are joined with the id-to-piece table for decoding. A group's documents follow from
    their rows alone, so a lost executor's groups are made again alike."""
    groups = _groups(docs)
    buckets = max(1, groups * GROUP // BUCKET)

    def deal(batches):
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def rows():
            return pd.DataFrame({"grp": pd.Series(list(held), dtype="int64"), "rows": pd.Series([_pack(ids + texts) for ids, texts in held.values()], dtype=object)})

        for batch in batches:
            for grp, doc_id, text in zip(batch["grp"].tolist(), batch["doc_id"], batch["text"]):
                ids, texts = held.setdefault(grp, ([], []))
                ids.append(b"" if doc_id is None else doc_id.encode())
                texts.append(text.encode("utf-8", "surrogatepass"))
                size += len(text)
                if size >= DEAL:
                    yield rows()
                    held, size = {}, 0
        yield rows()
        del held
        release()

    grp = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("long")
    rows = docs.select(grp.alias("grp"), F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"))
    dealt = rows.mapInPandas(deal, "grp long, rows binary").repartition(partitions(docs.sparkSession), "grp")

    def rows_of(frame: pd.DataFrame):
        """Documents in the order of their blobs: the shuffle may bring these in any order."""
        ids, texts = [], []
        for parts in map(_unpack, sorted(frame["rows"])):
            half = len(parts) // 2
            ids += [d.decode() or None for d in parts[:half]]
            texts += [t.decode("utf-8", "surrogatepass") for t in parts[half:]]
        return ids, texts

    def words(frame: pd.DataFrame) -> pd.DataFrame:
        found, _ = distinct_words(rows_of(frame)[1], buckets)
        full = [b for b in range(buckets) if found[b]]
        return pd.DataFrame({"bucket": pd.Series(full, dtype="int64"), "grp": pd.Series([frame["grp"].iat[0]] * len(full), dtype="int64"), "words": pd.Series([_pack(found[b]) for b in full], dtype=object)})

    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        lists = [_unpack(w) for w in frame["words"]]
        table = list(dict.fromkeys(chain.from_iterable(lists)))
        kind = id_type(path)
        ids = {}
        for start in range(0, len(table), 20000):
            part = table[start : start + 20000]
            ids.update(zip(part, (np.array(x, dtype=kind).tobytes() for x in encode_batch(path, [w.decode("utf-8", "surrogatepass") for w in part]))))
        back = [[ids[w] for w in words] for words in lists]
        own = [np.unique(np.frombuffer(b"".join(x), kind)).astype(np.int32) for x in back]
        release()
        return pd.DataFrame({"grp": frame["grp"], "bucket": frame["bucket"], "ids": [_pack(x) for x in back], "distinct_ids": own})

    table = dealt.groupBy("grp").applyInPandas(words, "bucket long, grp long, words binary").groupBy("bucket").applyInPandas(encode, "grp long, bucket long, ids binary, distinct_ids array<int>")
    table = cut(table, "encoded")
    own = table.groupBy("grp").agg(F.array_distinct(F.flatten(F.collect_list("distinct_ids"))).alias("ids"))  # at most one for each token of a group
    pieces = _pieces_by_group(own.select("grp", F.explode("ids").alias("id")), path)
    right = table.select("grp", "bucket", "ids").unionByName(pieces, allowMissingColumns=True)

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        doc_ids, texts = rows_of(left)
        found, split = distinct_words(texts, buckets)
        ids: dict[str, bytes] = {"": b""}
        for bucket, blob in zip(right["bucket"], right["ids"]):
            if blob is not None:
                ids.update(zip((w.decode("utf-8", "surrogatepass") for w in found[int(bucket)]), _unpack(blob)))
        del found, texts
        after = {w[1:]: v for w, v in ids.items() if w[:1] == " "}
        kind = id_type(path)
        lists = [np.frombuffer(b"".join([ids[first], *map(after.__getitem__, rest)] if rest is not None else map(ids.__getitem__, odd)), kind) for first, rest, odd in split]
        out = finish(doc_ids, lists, _lookup(right))
        del ids, after, lists, split
        release()
        return out

    out = dealt.groupBy("grp").cogroup(right.groupBy("grp")).applyInPandas(join, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs."""

    def finish(doc_ids, lists, pieces):
        return pd.DataFrame({"doc_id": doc_ids, "ids": [x.astype("int32") for x in lists]})

    return encode_documents(docs, path, finish, "doc_id string, ids array<int>")


def _text(ids, pieces: list[bytes]) -> str:
    """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): the distinct ids of a group of rows are joined with the id-to-piece table, of
    fixed size, and the pieces' bytes are put together in order (bytes that aren't UTF-8 become U+FFFD).

    Null ids are no text's: the text is null."""
    size = encoded.agg(F.sum(F.size("ids"))).first()[0] or 0
    groups = max(partitions(encoded.sparkSession), 1 + 4 * size // GROUP)
    rows = encoded.select(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(groups)).alias("grp"), F.col("doc_id").cast("string").alias("doc_id"), "ids")
    pieces = _pieces_by_group(rows.select("grp", F.explode(F.array_distinct("ids")).alias("id")).distinct(), path)

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = _lookup(right)
        return pd.DataFrame({"doc_id": left["doc_id"], "text": [None if x is None else _text(x, own) for x in left["ids"]]})

    out = rows.groupBy("grp").cogroup(pieces.withColumnRenamed("grp", "own").groupBy("own")).applyInPandas(work, "doc_id string, text string")
    return out.withColumn("doc_id", F.col("doc_id").cast(dict(encoded.dtypes)["doc_id"]))


def encode_report(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): doc_id, n_tokens,
    ids_sha256, decoded_sha256.

    A null or empty text has no ids and the digests of nothing. Repeated rows repeat. Texts of any
    length are encoded whole. An empty table gives no rows."""

    def finish(doc_ids, lists, pieces):
        return pd.DataFrame(
            {
                "doc_id": doc_ids,
                "n_tokens": [len(x) for x in lists],
                "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in lists],
                "decoded_sha256": [hashlib.sha256(_text(x, pieces).encode()).hexdigest() for x in lists],
            }
        )

    return encode_documents(docs, path, finish, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
