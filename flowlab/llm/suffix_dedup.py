"""Suffix-array dedup: byte strings that repeat, found by suffix arrays built in Lyndon groups."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import map_rows, new_table, partitions, release, text_of, write

#: Bytes that a task hashes at once; longer texts are hashed in overlapping parts.
CHUNK = 2_000_000
#: Differing contents of one key from which its windows are compared one by one, by their digests.
HOT = 32
#: Bytes that one bucket of contents, one slot of hits, and one bucket of suffix arrays are to hold: more data makes more of them.
BUCKET_BYTES, SLOT_BYTES, SORT_BYTES = 12_000_000, 16_000_000, 6_000_000
#: Symbols of the strings whose suffixes are sorted side by side.
SYMBOLS = 1_000_000


def _runs(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


def lyndon_groups(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, prev) of every suffix of some strings that lie one after another in text, each ended by its only, smallest symbol.

    Suffixes with one Lyndon prefix are a group, named by its first place in the order of the suffixes; prev is the nearest suffix
    before it, in its string, in a smaller group (-1: none). Groups begin as those of one first symbol and are processed from the greatest to
    the smallest; all strings advance side by side, each by one group in a step. The suffixes of a group find their prev by going from pointer
    to pointer; those pointed at, and among them those pointed at more often, are greater than the rest of their own group, so
    they leave it for new groups right behind it: their prefix has grown by the processed group's."""
    n = len(text)
    string = np.repeat(np.arange(len(first)), size)
    order = np.argsort(string * (int(text.max()) + 1) + text, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    new = np.flatnonzero(np.r_[True, (text[order][1:] != text[order][:-1]) | (string[order][1:] != string[order][:-1])])
    length = np.zeros(n, np.int64)
    length[new] = np.diff(np.r_[new, n])
    group = np.empty(n, np.int64)
    group[order] = np.repeat(new, length[new])
    prev = np.arange(n) - 1
    prev[first] = -1
    marked = np.zeros(n, bool)
    low, last = first.copy(), first + size - 1
    while len(last):
        start = group[order[last]]
        many = last - start + 1
        own, bound = order[_ranges(start, many)], np.repeat(start, many)
        to = prev[own]
        live = np.flatnonzero(to >= 0)
        while len(live):
            live = live[group[to[live]] >= bound[live]]
            to[live] = prev[to[live]]
            live = live[to[live] >= 0]
        prev[own] = to
        parents, times = np.unique(to[to >= 0], return_counts=True)
        if len(parents):
            home = group[parents]
            by = np.lexsort((times, home))
            parents, times, home = parents[by], times[by], home[by]
            at = _runs(home)
            leave, homes = np.diff(np.r_[at, len(home)]), home[at]
            begin = homes + length[homes] - leave
            slots = _ranges(begin, leave)
            # those that leave change places with those that stand at the end of their group
            old = place[parents]
            empty = old[old < np.repeat(begin, leave)]
            marked[parents] = True
            there = order[slots]
            there = there[~marked[there]]
            marked[parents] = False
            order[empty], place[there] = there, empty
            order[slots], place[parents] = parents, slots
            length[homes] -= leave
            at = np.flatnonzero(np.r_[True, (home[1:] != home[:-1]) | (times[1:] != times[:-1])])
            many = np.diff(np.r_[at, len(home)])
            length[slots[at]] = many
            group[parents] = np.repeat(slots[at], many)
        last = start - 1
        more = last >= low
        low, last = low[more], last[more]
    return group, prev


def suffix_arrays(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffixes of each string in order, the strings one after another (see lyndon_groups): every place that is known shows where
    the suffix before it, and what its prev pointers lead to, go: to the next free place of their groups."""
    group, prev = lyndon_groups(text, first, size)
    n = len(text)
    free, out, placed = np.arange(n), np.empty(n, np.int64), np.zeros(n, bool)
    begin, i, end = first.copy(), first.copy(), first + size - 1
    out[i], placed[end] = end, True
    free[i] += 1
    at = np.where(end > begin, end - 1, -1)
    while len(i):
        go = at >= 0
        go[go] = ~placed[at[go]]
        own = at[go]
        slot = free[group[own]]
        out[slot], placed[own] = own, True
        free[group[own]] = slot + 1
        at[go] = prev[own]
        rest = np.flatnonzero(~go)
        if len(rest):
            i[rest] += 1
            done = i > end
            if done.any():
                keep = ~done
                begin, i, end, at, go = begin[keep], i[keep], end[keep], at[keep], go[keep]
                rest = np.flatnonzero(~go)
            suffix = out[i[rest]]
            at[rest] = np.where(suffix > begin[rest], suffix - 1, -1)
    return out


def rolling(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all runs of `gram` bytes, put together from those of 1, 2, 4, ... bytes."""
    part = data.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    factor, size, out, done = 0x9E3779B97F4A7C15, 1, None, 0
    while True:
        if gram & size:
            if out is None:
                out = part
            else:
                n = min(len(out), len(part) - done)
                out = out[:n] * np.uint64(factor) + part[done : done + n]
            done += size
        if 2 * size > gram:
            break
        part = part[:-size] * np.uint64(factor) + part[size:]
        factor, size = factor * factor % (1 << 64), 2 * size
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchored(data: np.ndarray, sizes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, count): the starts of all windows of `width` bytes within some texts that lie one after another, as runs of
    consecutive starts with one anchor. A window's anchor is the run of `gram` bytes in it with the smallest hash, its key: equal windows have
    equal keys, and lie alike about their anchors, so no run has two equal windows."""
    none = np.zeros(0, np.int64)
    many = np.maximum(sizes - width + 1, 0)
    if not many.any():
        return none.astype(np.uint64), none, none
    hashes = rolling(data, gram)
    span, least = width - gram + 1, hashes
    step = 1
    while 2 * step <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if span > step:
        least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
    start = _ranges(np.cumsum(sizes) - sizes, many)
    own = least[start]
    # a run ends with its anchor's own place
    new = np.r_[True, (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1) | (hashes[start[:-1]] == own[:-1])]
    at = np.flatnonzero(new)
    return own[at], start[at], np.diff(np.r_[at, len(start)])


def later(docs: np.ndarray, starts: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which rows have a row with the same keys and a smaller (doc, start)."""
    out = np.zeros(len(docs), bool)
    by = np.argsort(keys[0], kind="stable")
    same = keys[0][by][1:] == keys[0][by][:-1]
    rows = by[np.r_[False, same] | np.r_[same, False]] if len(by) else by
    if len(rows):
        rows = rows[np.lexsort((starts[rows], docs[rows], *(k[rows] for k in reversed(keys))))]
        new = np.zeros(len(rows), bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[rows][1:] != k[rows][:-1]
        first = rows[new][np.cumsum(new) - 1]
        out[rows] = (docs[rows] != docs[first]) | (starts[rows] != starts[first])
    return out


#: kind 0: hits (docs, starts, counts), dealt by doc; 1: contents, by key; 2: asked for, by doc; 3: windows by digest; 4: contents with their bytes, by key.
ROWS = "kind int, part long, docs binary, starts binary, counts binary, keys binary, checks binary, text binary"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
HITS, CONTENTS, ASKED, WINDOWS, PIECES = range(5)
TYPES = {"docs": np.int64, "starts": np.uint32, "counts": np.uint8, "keys": np.uint64, "checks": np.uint64}


def blobs(kind: int, part: np.ndarray, text=None, **columns: np.ndarray) -> list[tuple]:
    """A row for each part, with its columns as bytes; text: a function of the rows' places."""
    by = np.argsort(part, kind="stable")
    cuts = np.r_[_runs(part[by]), len(by)].tolist()
    rows = []
    for s, e in zip(cuts[:-1], cuts[1:]):
        own = by[s:e]
        held = {c: v[own].astype(TYPES[c]).tobytes() for c, v in columns.items()}
        rows.append((kind, int(part[own[0]]), *(held.get(c) for c in TYPES), text(own) if text else None))
    return rows


def columns_of(frame: pd.DataFrame, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(frame[c]), TYPES[c]) for c in names]


def as_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES)


def scan(docs: DataFrame, width: int, gram: int, buckets: int, slots: int) -> DataFrame:
    """Rows of kinds 0 to 2 for the windows of all rows of docs with a doc_id. Of equal contents in one part of CHUNK bytes only the first
    leaves it, the others are hits; a key with over HOT contents in a part is hot: its contents are asked for at once, and a mark
    (count 0) tells its bucket."""

    def emit(ids, offsets, texts):
        raw = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        key, first, count = anchored(np.frombuffer(raw, np.uint8), sizes, width, gram)
        digest = xxhash.xxh3_64_intdigest
        check = np.fromiter((digest(raw[a:b]) for a, b in zip(first.tolist(), (first + count + width - 1).tolist())), np.uint64, len(first))
        which = np.searchsorted(np.cumsum(sizes), first, side="right")
        doc = np.array(ids, np.int64)[which]
        start = first - (np.cumsum(sizes) - sizes)[which] + np.array(offsets, np.int64)[which]
        hit = later(doc, start, key, check)
        rows = blobs(HITS, doc[hit] % slots, docs=doc[hit], starts=start[hit], counts=count[hit])
        doc, start, count, key, check = (x[~hit] for x in (doc, start, count, key, check))
        keys, place, times = np.unique(key, return_inverse=True, return_counts=True)
        hot = (times > HOT)[place]
        if hot.any():
            mark, none = keys[times > HOT], np.zeros(int((times > HOT).sum()), np.int64)
            rows += blobs(ASKED, doc[hot] % slots, docs=doc[hot], starts=start[hot], counts=count[hot], keys=key[hot], checks=np.ones(int(hot.sum())))
            rows += blobs(CONTENTS, (mark % np.uint64(buckets)).astype(np.int64), docs=none, starts=none, counts=none, keys=mark, checks=none)
            doc, start, count, key, check = (x[~hot] for x in (doc, start, count, key, check))
        rows += blobs(CONTENTS, (key % np.uint64(buckets)).astype(np.int64), docs=doc, starts=start, counts=count, keys=key, checks=check)
        return as_rows(rows)

    def work(batches):
        ids, offsets, texts, size = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"]):
                raw = text.encode("utf-8", "surrogatepass")
                for begin in range(0, max(1, len(raw) - width + 1), CHUNK):
                    part = raw[begin : begin + CHUNK + width - 1]
                    if len(part) >= width:
                        ids.append(doc_id)
                        offsets.append(begin)
                        texts.append(part)
                        size += len(part)
                    if size >= CHUNK:
                        yield emit(ids, offsets, texts)
                        ids, offsets, texts, size = [], [], [], 0
        if ids:
            yield emit(ids, offsets, texts)
        del ids, texts
        release()

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInPandas(work, ROWS)


def compare_contents(frame: pd.DataFrame, slots: int) -> pd.DataFrame:
    """The contents of one bucket of keys: all but the first of equal ones are hits; keys with several contents are asked for."""
    docs, starts, counts, keys, checks = columns_of(frame, *TYPES)
    marked, mark = np.unique(keys[counts == 0]), counts == 0
    docs, starts, counts, keys, checks = (x[~mark] for x in (docs, starts, counts, keys, checks))
    hit = later(docs, starts, keys, checks)
    rows = blobs(HITS, docs[hit] % slots, docs=docs[hit], starts=starts[hit], counts=counts[hit])
    docs, starts, counts, keys = (x[~hit] for x in (docs, starts, counts, keys))
    found, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    hot = (times > HOT) | np.isin(found, marked)
    asked = ((times > 1) | hot)[place]
    rows += blobs(ASKED, docs[asked] % slots, docs=docs[asked], starts=starts[asked], counts=counts[asked], keys=keys[asked], checks=hot[place][asked])
    return as_rows(rows)


def by_document(frame: pd.DataFrame) -> pd.DataFrame:
    """(own, starts, counts, keys, checks): what is asked for of each document of a slot."""
    docs, starts, counts, keys, checks = columns_of(frame, *TYPES)
    by = np.argsort(docs, kind="stable")
    cuts = np.r_[_runs(docs[by]), len(by)].tolist()
    parts = [by[s:e] for s, e in zip(cuts[:-1], cuts[1:])]
    return pd.DataFrame({"own": docs[[p[0] for p in parts]], "starts": [starts[p].tobytes() for p in parts], "counts": [counts[p].tobytes() for p in parts], "keys": [keys[p].tobytes() for p in parts], "checks": [checks[p].astype(np.uint8).tobytes() for p in parts]})


def extract(rows: DataFrame, width: int, buckets: int, slots: int) -> DataFrame:
    """Rows of kinds 0, 3 and 4 from documents with what is asked for: contents with their bytes; of hot keys each window by its digest of
    128 bits, of equal windows in a part only the first, the others are hits."""

    def emit(whole, single):
        out = []
        if whole:
            docs, starts, counts, keys, parts = zip(*whole)
            key = np.array(keys, np.uint64)
            pack = zstandard.ZstdCompressor(level=1).compress
            out += blobs(PIECES, (key % np.uint64(buckets)).astype(np.int64), lambda own: pack(b"".join(parts[i] for i in own.tolist())), docs=np.array(docs, np.int64), starts=np.array(starts), counts=np.array(counts), keys=key)
        if single:
            docs, starts, digests = zip(*single)
            docs, starts = np.array(docs, np.int64), np.array(starts, np.int64)
            high, low = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2).T.copy()
            hit = later(docs, starts, high, low)
            out += blobs(HITS, docs[hit] % slots, docs=docs[hit], starts=starts[hit], counts=np.ones(int(hit.sum())))
            docs, starts, high, low = (x[~hit] for x in (docs, starts, high, low))
            out += blobs(WINDOWS, (high % np.uint64(buckets)).astype(np.int64), docs=docs, starts=starts, keys=high, checks=low)
        return as_rows(out)

    def work(batches):
        whole, single, size = [], [], 0
        for batch in batches:
            for doc_id, text, starts, counts, keys, checks in zip(batch["doc_id"].tolist(), batch["text"], batch["starts"], batch["counts"], batch["keys"], batch["checks"]):
                raw = text.encode("utf-8", "surrogatepass")
                for start, count, key, hot in zip(np.frombuffer(starts, np.uint32).tolist(), counts, np.frombuffer(keys, np.uint64).tolist(), checks):
                    count = min(count, len(raw) - width + 1 - start)  # another row may have the id too, with a longer text
                    if count > 0 and hot:
                        single += [(doc_id, i, xxhash.xxh3_128_digest(raw[i : i + width])) for i in range(start, start + count)]
                        size += 50 * count
                    elif count > 0:
                        whole.append((doc_id, start, count, key, raw[start : start + count + width - 1]))
                        size += count + width + 100
                if size >= 2 * CHUNK:
                    yield emit(whole, single)
                    whole, single, size = [], [], 0
        yield emit(whole, single)
        release()

    return rows.mapInPandas(work, ROWS)


def equal_neighbours(data: np.ndarray, suffixes: np.ndarray, width: int) -> np.ndarray:
    """Whether each suffix has the same first `width` symbols as the one before it."""
    out = np.zeros(len(suffixes), bool)
    if len(suffixes) > 1:
        look = np.lib.stride_tricks.sliding_window_view(data, width)
        for s in range(1, len(suffixes), 20_000):
            e = min(s + 20_000, len(suffixes))
            out[s:e] = (look[suffixes[s:e]] == look[suffixes[s - 1 : e - 1]]).all(axis=1)
    return out


def sort_contents(frame: pd.DataFrame, width: int, slots: int) -> pd.DataFrame:
    """Hits of a bucket of contents (kind 4): those of one key are joined to one string, their suffixes are sorted, and of suffixes that share
    `width` bytes all but that of the smallest (doc, start) are hits."""
    docs, starts, counts, keys = columns_of(frame, "docs", "starts", "counts", "keys")
    raw = b"".join(map(zstandard.ZstdDecompressor().decompress, frame["text"]))
    size = counts.astype(np.int64) + width - 1
    at = np.cumsum(size) - size
    # strings of about equal length stand together, so that they advance side by side
    _, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, size + 1).astype(np.int64)
    alone = np.bincount(place) == 1
    by = np.lexsort((docs, place, total[place]))
    by = by[~alone[place[by]]]
    rows: list[tuple] = []
    cuts, held = [0], 0
    for i in _runs(place[by]).tolist():
        held += int(total[place[by[i]]])
        if i > cuts[-1] and (held > SYMBOLS or total[place[by[i]]] > 2 * total[place[by[cuts[-1]]]] + 500):
            cuts.append(i)
            held = int(total[place[by[i]]])
    source = np.frombuffer(raw, np.uint8)
    for s, e in zip(cuts, [*cuts[1:], len(by)]):
        own = by[s:e]
        if not len(own):
            continue
        n = size[own] + 1  # each with a sign behind it: 0 ends a string, 1 only a content
        text = np.empty(int(n.sum()), np.int64)
        begin = np.cumsum(n) - n
        text[_ranges(begin, size[own])] = source[_ranges(at[own], size[own])].astype(np.int64) + 2
        text[begin + size[own]] = 1
        first = _runs(place[own])
        text[np.r_[begin[first[1:]], len(text)] - 1] = 0
        order = suffix_arrays(text, begin[first], np.diff(np.r_[begin[first], len(text)]))
        # the windows that are asked for, in order
        core = np.full(len(text), -1, np.int64)
        core[_ranges(begin, counts[own].astype(np.int64))] = np.repeat(np.arange(len(own)), counts[own])
        order = order[core[order] >= 0]
        equal = equal_neighbours(text.astype(np.uint16), order, width)
        string = place[own][core[order]]
        equal[1:] &= string[1:] == string[:-1]
        group = np.cumsum(~equal)
        which = core[order]
        doc, start = docs[own][which], starts[own][which].astype(np.int64) + order - begin[which]
        hit = later(doc, start, group)
        rows += blobs(HITS, doc[hit] % slots, docs=doc[hit], starts=start[hit], counts=np.ones(int(hit.sum())))
    release()
    return as_rows(rows)


def compare_windows(frame: pd.DataFrame, slots: int) -> pd.DataFrame:
    docs, starts, keys, checks = columns_of(frame, "docs", "starts", "keys", "checks")
    hit = later(docs, starts, keys, checks)
    return as_rows(blobs(HITS, docs[hit] % slots, docs=docs[hit], starts=starts[hit], counts=np.ones(int(hit.sum()))))


def covered(frame: pd.DataFrame, width: int) -> pd.DataFrame:
    """(own, gone) of a slot of hits: the removed bytes of each document as rising starts and ends, 32 bits each."""
    docs, starts, counts = columns_of(frame, "docs", "starts", "counts")
    by = np.lexsort((starts, docs))
    docs, begin, end = docs[by], starts[by].astype(np.int64), starts[by].astype(np.int64) + counts[by] + width - 1
    cuts = np.r_[_runs(docs), len(docs)].tolist()
    out = []
    for s, e in zip(cuts[:-1], cuts[1:]):
        reach = np.maximum.accumulate(end[s:e])
        new = np.r_[True, begin[s + 1 : e] > reach[:-1]]
        last = np.r_[np.flatnonzero(new)[1:] - 1, e - s - 1]
        out.append((docs[s], np.stack([begin[s:e][new], reach[last]], axis=1).astype("<u4").tobytes()))
    return pd.DataFrame(out, columns=["own", "gone"])


def suffix_dedup(docs: DataFrame, width: int = 100, gram: int = 50, texts: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, an integer, and text; other columns are ignored): doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 and, with `texts`, kept (binary: the bytes that are left, as cuts may fall inside a character).

    Every byte of a text in UTF-8 is removed that is covered by a string of `width` bytes which also starts earlier: in a document with a smaller
    doc_id, or before in the same; judged on the input. A null text is empty. A doc_id names one document: of rows that repeat it with another
    text, places removed in one are removed in all. A null doc_id is no document: its row keeps all bytes. An empty table gives no rows.

    All windows of `width` bytes are dealt by their anchor (see anchored), as runs of starts with their common content. Equal contents, by
    the anchor's hash and another of the content, 128 bits together, are hits but for the first. Contents that share an anchor but differ are
    fetched, joined to one string for each anchor, and the suffixes of the strings are sorted by their Lyndon groups: neighbours that agree in
    `width` bytes are equal windows. Anchors with over HOT contents (a frequent line in ever other surroundings) are dealt by
    whole windows instead, after each task has compared its own, so that no task gets them all."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    buckets, slots = max(partitions(spark), 1 + size // BUCKET_BYTES), max(1, 1 + size // SLOT_BYTES)
    first, second = new_table(spark, "contents"), new_table(spark, "pieces")

    def table(path: str, kind: int) -> DataFrame:
        return spark.read.schema(ROWS).parquet(path).where(F.col("kind") == kind)

    found = scan(docs, width, gram, buckets, slots)
    # hits and what is asked for pass by on their way; contents meet in their buckets
    write(found, first, "kind")
    merged = table(first, CONTENTS).groupBy("part").applyInPandas(lambda f: compare_contents(f, slots), ROWS)
    third = new_table(spark, "compared")
    write(merged, third, "kind")
    asked = table(first, ASKED).unionByName(table(third, ASKED))
    bytes_asked = asked.agg(F.sum(F.length("counts"))).first()[0] or 0
    parts = max(partitions(spark), 1 + 2 * width * bytes_asked // SORT_BYTES)
    wanted = asked.groupBy("part").applyInPandas(by_document, "own long, starts binary, counts binary, keys binary, checks binary")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.join(wanted, F.col("doc_id") == F.col("own")).select("doc_id", "text", "starts", "counts", "keys", "checks")
    write(extract(rows, width, parts, slots), second, "kind")
    hits = [table(first, HITS), table(third, HITS), table(second, HITS)]
    hits.append(table(second, PIECES).groupBy("part").applyInPandas(lambda f: sort_contents(f, width, slots), ROWS))
    hits.append(table(second, WINDOWS).groupBy("part").applyInPandas(lambda f: compare_windows(f, slots), ROWS))
    total = hits[0]
    for more in hits[1:]:
        total = total.unionByName(more)
    gone = total.groupBy("part").applyInPandas(lambda f: covered(f, width), "own long, gone binary")
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if texts else 5]

    def work(batches):
        for batch in batches:
            out, size = [], 0
            for doc_id, text, spans in zip(batch["doc_id"].tolist(), batch["text"], batch["gone"]):
                raw = text.encode("utf-8", "surrogatepass")
                left, at, count = [], 0, 0
                for begin, end in np.frombuffer(spans, "<u4").reshape(-1, 2).tolist() if spans is not None else ():
                    if begin < len(raw):
                        left.append(raw[at:begin])
                        at, count = min(end, len(raw)), count + 1
                kept = b"".join([*left, raw[at:]])
                row = (doc_id, len(raw), len(raw) - len(kept), count, hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if texts else row)
                size += len(raw)
                if size > 1 << 22:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=columns)
        release()

    rows = docs.select("doc_id", text_of().alias("text")).join(gone, F.col("doc_id").cast("long") == F.col("own"), "left").select("doc_id", "text", "gone")
    return map_rows(rows, work, "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
