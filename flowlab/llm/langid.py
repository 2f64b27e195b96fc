"""Language ID by cross-parsing: the language whose text needs the fewest copied phrases wins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.common import digest_of, drop_rows, map_rows, release, text_of

#: Labelled rows per language that are learned from, whole, taken by a hash of doc_id: those with a usual number of
#: characters first, then the others by how near theirs are.
SAMPLE_ROWS = 24
USUAL = (200, 2000)
#: Characters whose texts are parsed together, and symbols of a segment: segments are parsed side by side.
CHUNK, SEGMENT = 1 << 21, 4096

_letters: dict = {}


def _is_letter(points: np.ndarray) -> np.ndarray:
    if "table" not in _letters:
        _letters["table"] = np.fromiter((chr(v).isalpha() for v in range(1 << 16)), bool, 1 << 16)
    out = _letters["table"][np.minimum(points, 65535)]
    high = np.flatnonzero(points > 65535)
    if len(high):
        values, back = np.unique(points[high], return_inverse=True)
        out[high] = np.array([chr(v).isalpha() for v in values.tolist()], bool)[back]
    return out


def fold_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, bounds, letters) of some texts: code points of each lower-cased text, one after another, every run of
    characters that are no letters as one 0, and a 0 before each text; where texts begin and end; their numbers of letters."""
    raw = [f" {t.lower()}".encode("utf-32-le", "surrogatepass") for t in texts]
    points = np.frombuffer(b"".join(raw), np.uint32)
    first = np.cumsum([0, *(len(r) // 4 for r in raw)])
    letter = _is_letter(points)
    keep = letter | np.r_[True, letter[:-1]]
    keep[first[:-1]] = True
    bounds = np.r_[0, np.cumsum(keep)][first]
    seen = np.r_[0, np.cumsum(letter)][first]
    return np.where(letter, points, 0)[keep], bounds, np.diff(seen)


def suffix_automaton(symbols: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (state, symbol, next state) of the automaton of all substrings, state 0 the start: at most three times as
    many as symbols."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and s not in step[p]:
            step[p][s] = new
            p = link[p]
        if p >= 0:
            q = step[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(s) == q:
                    step[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    sizes = [len(own) for own in step]
    return np.repeat(np.arange(len(step)), sizes), np.array([s for own in step for s in own], np.int64), np.array([t for own in step for t in own.values()], np.int64)


def displace(states: np.ndarray, symbols: np.ndarray, nexts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, next): the edges in one array, without gaps for absent ones: that of a state by a symbol is at
    base[state] + symbol if the owner there is the state. `width` is a symbol that no edge has."""
    count = np.bincount(states, minlength=int(max(states.max(initial=0), nexts.max(initial=0))) + 1)
    order = np.argsort(states, kind="stable")
    own = np.split(symbols[order], np.cumsum(count)[:-1])
    base = np.zeros(len(count), np.int64)
    used = bytearray(b"\1" * width)  # edges by any symbol miss here
    at = 0
    for state in np.argsort(-count, kind="stable")[: int((count > 1).sum())].tolist():
        mine = own[state].tolist()
        if len(used) < at + 4 * width + 4096:
            used += bytes(width + (1 << 16))
        while any(used[at + s] for s in mine):
            at += 1
            if len(used) < at + 2 * width:
                used += bytes(width + (1 << 16))
        for s in mine:
            used[at + s] = 1
        base[state] = at
    single = np.flatnonzero(count == 1)
    used += bytes(len(single))
    free = np.flatnonzero(np.frombuffer(used, np.uint8) == 0)[: len(single)]
    base[single] = free - np.array([own[s][0] for s in single.tolist()], np.int64)
    owner = np.full(int(base.max()) + width + 1, -1, np.int64)
    to = np.zeros(len(owner), np.int64)
    slot = base[states] + symbols
    owner[slot], to[slot] = states, nexts
    return base, owner, to


@dataclass
class Models:
    """The automata of all languages side by side: names; code points of the joint alphabet; each language's own number for
    a joint symbol (the last column: a letter that no language has, and the end of a text); start states; base, owner and next;
    bits of a phrase; the state in which parsed lanes rest, whatever they read."""

    names: list[str]
    points: np.ndarray
    own: np.ndarray
    root: np.ndarray
    base: np.ndarray
    owner: np.ndarray
    next: np.ndarray
    bits: np.ndarray
    rest: int

    def symbols(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at, len(self.points))


def join_models(rows) -> Models | None:
    """Of rows (lang, points, base, owner, next, size); None without any."""
    rows = sorted(rows, key=lambda r: r["lang"])
    own = [np.frombuffer(r["points"], np.uint32) for r in rows]
    rows, own = [r for r, p in zip(rows, own) if p.any()], [p for p in own if p.any()]
    if not rows:
        return None
    points = np.unique(np.concatenate(own))
    table = np.empty((len(rows), len(points) + 1), np.int64)
    root, parts, states, slots = [], [], 0, 0
    for i, (r, mine) in enumerate(zip(rows, own)):
        table[i] = len(mine)
        table[i, np.searchsorted(points, mine)] = np.arange(len(mine))
        base, owner, to = (np.frombuffer(r[k], np.int32).astype(np.int64) for k in ("base", "owner", "next"))
        parts.append((base + slots, np.where(owner < 0, -1, owner + states), to + states))
        root.append(states)
        states, slots = states + len(base), slots + len(owner)
    widest = int(table.max()) + 1
    parts.append((np.array([slots]), np.full(widest, states), np.full(widest, states)))
    base, owner, to = (np.concatenate(x) for x in zip(*parts))
    return Models([r["lang"] for r in rows], points, table, np.array(root), base, owner, to, np.array([np.log2(max(2, r["size"])) for r in rows]), states)


def learn(docs: DataFrame, sample: int = SAMPLE_ROWS) -> Models | None:
    """The automata of the languages of rows (doc_id, text, lang), each from at most `sample` of its rows, whole.

    Ranks are found without the texts, and the texts of the chosen ids are then fetched. One task builds one language's
    automaton; the driver gets at most 7 numbers for each symbol of the samples."""
    known = docs.where("lang is not null and doc_id is not null")
    size = F.char_length(text_of())
    far = F.when(size < USUAL[0], USUAL[0] - size).when(size > USUAL[1], size - USUAL[1]).otherwise(0)
    order = Window.partitionBy("lang").orderBy(far, F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang", F.row_number().over(order).alias("rank")).where(F.col("rank") <= sample)
    chosen = known.select("doc_id", "lang", text_of().alias("text")).join(F.broadcast(ids), ["doc_id", "lang"])

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        stream = np.r_[fold_texts(frame.sort_values(["rank", "text"])["text"].tolist())[0], 0]
        points = np.unique(stream)
        packed = displace(*suffix_automaton(np.searchsorted(points, stream).tolist()), len(points))
        release()
        return pd.DataFrame({"lang": [frame["lang"].iat[0]], "points": [points.astype(np.uint32).tobytes()], **{k: [v.astype(np.int32).tobytes()] for k, v in zip(("base", "owner", "next"), packed)}, "size": [len(stream)]})

    return join_models(chosen.select("lang", "rank", "text").groupBy("lang").applyInPandas(build, "lang string, points binary, base binary, owner binary, next binary, size long").collect())


def _walk(models: Models, flat: np.ndarray, at: np.ndarray, limit: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrases, exit) of lanes: how many phrases one after another begin in at..limit, the first at `at`, and where the last
    ends. A symbol that the language has nowhere is a phrase of its own; the mark at a text's end ends a phrase."""
    width, own = models.own.shape[1], models.own.ravel()
    count, leave = np.zeros(len(at), np.int64), at.copy()
    lane = np.flatnonzero(at < limit)
    pos, limit, root, row = at[lane], limit[lane], models.root[lang[lane]], lang[lane] * width
    state, number, pace = root.copy(), np.zeros(len(lane), np.int64), np.ones(len(lane), np.int64)
    ended = 0
    while len(lane):
        slot = models.base[state] + own[row + flat[pos]]
        found = models.owner[slot] == state
        to = models.next[slot]
        pos += pace
        missed = np.flatnonzero(~found)
        if len(missed):
            first = root[missed]
            pos[missed] -= state[missed] != first  # this symbol begins the next phrase, unless the language has it nowhere
            number[missed] += 1
            to[missed] = first
            over = missed[pos[missed] >= limit[missed]]
            if len(over):
                count[lane[over]], leave[lane[over]] = number[over], pos[over]
                to[over], pace[over] = models.rest, 0
                ended += len(over)
        state = to
        if ended * 8 > len(lane):
            live = np.flatnonzero(pace)
            lane, pos, limit, root, row, state, number, pace = (x[live] for x in (lane, pos, limit, root, row, state, number, pace))
            ended = 0
    return count, leave


def phrases(models: Models, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Phrases (language, text) of texts that `bounds` cut out of joint symbols: the longest matches with the language's text, one
    after another.

    Long texts are parsed in segments side by side, each first as if a phrase began at its border; a segment whose
    predecessor's last phrase ends elsewhere is parsed again from there, until all fit together."""
    sizes = np.diff(bounds)
    flat = np.insert(symbols, bounds[1:], len(models.points))
    bounds = bounds + np.arange(len(bounds))
    many = np.maximum(1, -(-sizes // SEGMENT))
    text = np.repeat(np.arange(len(sizes)), many)
    begin = bounds[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * SEGMENT
    limit = np.minimum(begin + SEGMENT, (bounds[1:] - 1)[text])
    k = len(models.names)
    lang, same = np.repeat(np.arange(k), len(text)), np.tile(np.r_[text[1:] == text[:-1], False], k)
    entry, limit = np.tile(begin, k), np.tile(limit, k)
    count, leave = np.zeros(len(entry), np.int64), entry.copy()
    todo = np.arange(len(entry))
    while len(todo):
        count[todo], leave[todo] = _walk(models, flat, entry[todo], limit[todo], lang[todo])
        after = todo[same[todo]] + 1
        todo = after[entry[after] != leave[after - 1]]
        entry[todo] = leave[todo - 1]
    return np.bincount(lang * len(sizes) + np.tile(text, k), count, k * len(sizes)).astype(np.int64).reshape(k, -1)


def predict_language(docs: DataFrame, train: DataFrame, unlearned: str = "und", sample: int = SAMPLE_ROWS, beside: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored) with doc_id, lang_pred, score.

    The language with the fewest normalised phrases wins: phrases times the binary logarithm of the symbols it was
    learned from, as a phrase is a place in that text, over the text's own symbols. score: by how much the winner's are fewer than
    the next language's, as a share of the next's (with one language: of a phrase for each symbol). Ties go to the first language in
    order of name. A text without a letter, empty or null, is `und` with score 0; every other text is `unlearned` if nothing
    could be learned. `beside` names a column that is handed on. At most `sample` rows a language are learned from; texts of any length are parsed whole. Repeated rows
    repeat; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(train, sample))
    columns = ["doc_id", *([beside] if beside else []), "text"]

    def judge(models, rows, texts):
        own = dict(zip(("doc_id", beside), zip(*rows)))
        points, bounds, letters = fold_texts(texts)
        if models is None:
            return pd.DataFrame(own | {"lang_pred": [unlearned if n else "und" for n in letters.tolist()], "score": 0.0})
        size = np.diff(bounds)
        need = phrases(models, models.symbols(points), bounds) * models.bits[:, None] / size
        best = need.argmin(axis=0)
        next_best = np.sort(need, axis=0)[1] if len(need) > 1 else np.full(len(texts), models.bits[0])
        score = np.where(letters > 0, np.clip(1 - need.min(axis=0) / next_best, 0, 1), 0.0)
        return pd.DataFrame(own | {"lang_pred": [models.names[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist())], "score": score})

    def work(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for *row, text in zip(*(batch[c] for c in columns)):
                ids.append(row)
                texts.append(text)
                size += len(text)
                if size >= CHUNK:
                    yield judge(shared.value, ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield judge(shared.value, ids, texts)
        del ids, texts
        release()

    kept = f"{beside} {dict(docs.dtypes)[beside]}, " if beside else ""
    return map_rows(docs.select(*columns[:-1], text_of().alias("text")), work, kept + "lang_pred string, score double")


def held_out(fold: int = 3, rest: int = 1):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == rest, F.lit(False))


def language_report(docs: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """predict_language for docs (doc_id, text, lang), learned from their own labelled rows that are not
    held out; lang_pred and score with held_out."""
    found = predict_language(docs, docs.where(~held_out()), sample=sample)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def drop_undetermined(docs: DataFrame) -> DataFrame:
    """docs without those in which no language is found: null texts and texts without a letter.

    Each row is judged by its own text, with or without a doc_id. Where no language could be learned, texts with a letter stay."""
    rows = docs.select("doc_id", "text", digest_of().alias("digest"))
    found = predict_language(rows, docs.where(~held_out()), unlearned="unlearned", beside="digest")
    return drop_rows(docs, found.where("lang_pred = 'und'").select("doc_id", "digest").distinct(), "undetermined")
