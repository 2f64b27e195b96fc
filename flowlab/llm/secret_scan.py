"""Secret scan by a trigram inverted index: Boolean trigram queries, postings, verification.

Native: the rules' queries are derived on the driver from the patterns; all work on documents is
DataFrame functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import MAX_BROADCAST_IDS, SHORT, cut, fresh, text_of

#: Documents of one posting block: no posting list is longer.
BLOCK = 4096
#: Literal strings a part of a pattern may stand for before it is given up as a source of trigrams.
MAX_STRINGS = 64
#: The column of spans, and its type.
SPANS, SPAN = "__spans", "array<struct<start:int,ord:int,end:int>>"
#: Spans that are put together before they are joined with those of a text's other blocks.
ITEMS = 128


@dataclass(frozen=True)
class Rule:
    """kind, pattern (group `group` of at least `least` characters, else the match fails), and
    whether ASCII letters match in either case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False


#: Base rules in the order of their kinds. A run of 16 or 18 characters is asked for in the pattern
#: itself: leftmost longest runs that are shorter fail either way.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Rules this scanner adds to the base ones.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def _strings(item) -> set[str] | None:
    """All strings a parsed item can match, None if there are more than MAX_STRINGS."""
    op, value = item
    if op is ops.LITERAL:
        return {chr(value)}
    if op is ops.IN and all(o is ops.LITERAL for o, _ in value) and len(value) <= 8:
        return {chr(v) for _, v in value}
    if op is ops.SUBPATTERN:
        return _sequence(value[3])
    if op is ops.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        return None if None in parts else set().union(*parts)
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[1] <= 3:
        once = _sequence(value[2])
        if once is None:
            return None
        out: set[str] = set()
        for n in range(value[0], value[1] + 1):
            out |= reduce(lambda acc, _: {a + b for a in acc for b in once}, range(n), {""})
        return out if len(out) <= MAX_STRINGS else None
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for item in items:
        more = _strings(item)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(rule: Rule) -> list[frozenset[str]] | None:
    """The Boolean query of a rule, as alternatives of trigrams that must all occur: every text with
    a match fulfils one. None: no trigram is mandatory, the rule scans fully.

    The pattern is cut into runs of items with few strings; each run gives one query (an
    alternative for each string), and the one whose weakest alternative has most trigrams is taken."""
    runs: list[set[str]] = [{""}]
    for item in parser.parse(rule.pattern):
        more = _strings(item)
        if more is None:
            runs.append({""})
        elif len(runs[-1]) * len(more) > MAX_STRINGS:
            runs.append(more)
        else:
            runs[-1] = {a + b for a in runs[-1] for b in more}
    queries = [{frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in ({x.lower() for x in run} if rule.fold else run)} for run in runs]
    best = max(queries, key=lambda q: min(map(len, q)))
    best = {a for a in best if not any(b < a for b in best)}  # a weaker alternative covers a stronger one
    return None if not min(map(len, best)) else sorted(best, key=sorted)


def candidates(docs: DataFrame, rules) -> DataFrame:
    """(doc_id, rules array<int>): the documents that each indexed rule's query leaves.

    The inverted index has a posting list (trigram, block, ids) for each trigram that some query
    asks for, in blocks of BLOCK ids so that no list outgrows a task. Lists of one block are
    intersected within an alternative, then united over the alternatives of a rule."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r))}
    grams = sorted({(g, rules[i].fold) for i, q in queries.items() for alt in q for g in alt})
    if not grams:
        return docs.select("doc_id", F.array().cast("array<int>").alias("rules")).limit(0)
    found = F.filter(F.array(*[F.when(F.contains("lower" if fold else "text", F.lit(g)), F.lit(n)) for n, (g, fold) in enumerate(grams)]), lambda x: x.isNotNull())
    texts = docs.where("doc_id is not null").select("doc_id", text_of().alias("text"), F.lower(text_of()).alias("lower"))
    postings = texts.select("doc_id", F.explode(found).alias("gram"))
    block = F.shiftright(F.col("doc_id").cast("long"), BLOCK.bit_length() - 1)
    lists = postings.groupBy(block.alias("block"), "gram").agg(F.collect_set("doc_id").alias("ids"))
    index = lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("lists"))
    number = {g: n for n, g in enumerate(grams)}
    kind = dict(docs.dtypes)["doc_id"]
    empty = F.array().cast(f"array<{kind}>")
    asked = F.array(*[F.struct(F.lit(i).alias("rule"), F.array(*[F.lit(number[(g, rules[i].fold)]) for g in sorted(alt)]).alias("grams")) for i, q in queries.items() for alt in q])
    of = index.select("lists", F.explode(asked).alias("asked")).select("asked.rule", "asked.grams", "lists")

    def ids(gram: Column) -> Column:
        return F.coalesce(F.try_element_at("lists", gram), empty)

    both = F.aggregate(F.slice("grams", 2, F.size("grams")), ids(F.get("grams", F.lit(0))), lambda left, g: F.array_intersect(left, ids(g)))
    rows = of.select("rule", F.explode(both).alias("doc_id"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_blocks(items: Column, start: Column, add, kind: str, finish) -> Column:
    """finish(at, parts) of a running value `at` and what each block of items gives: add(acc, item) works on (at, out) within
    a block, out beginning empty (of type `kind`). Blocks keep the work in proportion to the items: one growing array or text would be
    copied for each."""
    none = F.lit("") if kind == "string" else F.array().cast(kind)
    zero = F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def block(acc, j):
        done = lambda own: F.struct(own["at"].alias("at"), F.array_append(acc["out"], own["out"]).alias("out"))
        return F.aggregate(F.slice(items, j * ITEMS + 1, F.lit(ITEMS)), F.struct(acc["at"].alias("at"), none.alias("out")), add, done)

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / ITEMS).cast("int"))
    return F.aggregate(blocks, zero, block, lambda acc: finish(acc["at"], acc["out"]))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches of a rule: array of (start, ord, end), in code points, end exclusive."""
    pattern = ("(?i)" if rule.fold else "") + rule.pattern

    def found(whole):
        gaps = F.split(text, pattern, -1)  # one more than matches
        kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else whole
        rows = F.arrays_zip(whole.alias("whole"), gaps.alias("gap"), kept.alias("kept"))

        def add(acc, x):
            begin = acc["at"] + F.char_length(x["gap"])
            end = begin + F.coalesce(F.char_length(x["whole"]), F.lit(0))
            span = F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"))
            good = F.char_length(x["kept"]) >= rule.least
            return F.struct(end.alias("at"), F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return let(rows, lambda z: in_blocks(z, F.lit(0), add, SPAN, lambda at, parts: F.flatten(parts)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda whole: F.when(F.size(whole) > 0, found(whole)).otherwise(F.array().cast(SPAN)))


def joined(spans: Column, names: list[str]) -> Column:
    """kind:start:end of each span, by start and then kind, joined by commas."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, rules=BASE_RULES + MORE_RULES, name: str = SPANS) -> DataFrame:
    """docs with a column `name`: array of (start, ord, end), ord the number of the rule.

    Rules with mandatory trigrams are verified on the candidates that the index leaves; the
    others scan every text. Candidates are looked up by doc_id: broadcast where there are few, else by a shuffled join."""
    asked, key = fresh(docs, "__rules"), fresh(docs, "__id")
    left = cut(candidates(docs, rules), "candidates", SHORT).select(F.col("doc_id").alias(key), F.col("rules").alias(asked))
    left = F.broadcast(left) if left.count() <= MAX_BROADCAST_IDS // 8 else left  # a row has an id and up to len(rules) numbers
    text = text_of()
    unknown = F.col("doc_id").isNull()  # a row without an id is in no posting list
    parts = [F.when(F.array_contains(asked, i) | unknown, spans_of(text, r, i)).otherwise(F.array().cast(SPAN)) if trigram_query(r) else spans_of(text, r, i) for i, r in enumerate(rules)]
    return docs.join(left, F.col("doc_id") == F.col(key), "left").withColumn(name, F.concat(*parts)).drop(asked, key)


def secret_report(docs: DataFrame, base=BASE_RULES, more=MORE_RULES) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): doc_id, n_assign,
    n_access, n_hex, base_sha256, spans.

    A null text counts as empty: no spans, the digest of the empty string. Repeated rows repeat.
    An empty table gives no rows."""
    rules = tuple(base) + tuple(more)
    names = [r.kind for r in rules]
    found = scan(docs.select("doc_id", "text"), rules).select("doc_id", SPANS)
    own = F.filter(SPANS, lambda s: s["ord"] < len(base))

    def count(ord: int) -> Column:
        return F.size(F.filter(SPANS, lambda s: s["ord"] == ord)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(base)]
    return found.select("doc_id", *counts, F.sha2(joined(own, names), 256).alias("base_sha256"), joined(F.col(SPANS), names).alias("spans"))


def redact(docs: DataFrame, rules=BASE_RULES + MORE_RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret span replaced by a mark (overlapping spans by one); n_chars, where it
    exists, follows the new text. Texts without secrets stay as they are, null included."""
    spans = fresh(docs, SPANS)
    found = scan(docs, rules, spans)
    text = text_of()

    def add(acc, s):
        # a span that begins inside the last one only moves its end
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(piece).alias("out"))

    def whole(at, parts):
        return F.concat(F.array_join(parts, ""), F.substr(text, at + 1, F.char_length(text)))

    clean = let(F.array_sort(spans), lambda z: in_blocks(z, F.lit(0), add, "string", whole))
    some = F.size(spans) > 0
    out = found.withColumn("text", F.when(some, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
