"""Secret scans: a trigram inverted index gives each rule its candidate texts, regexes verify them; DataFrame functions only.

One pass writes the postings (trigram, row) of the trigrams that the rules ask for. The Boolean trigram queries derived from the rules'
regexes are answered from the postings alone, and only the texts they leave are read again and verified. A rule whose
regex has no mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
import re._constants as rc
import re._parser as rp
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, fits, table


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: The group whose length counts, and the least length; shorter matches are dropped after matching.
    group: int = 0
    least: int = 1
    any_case: bool = False
    #: What a match of ``regex`` reaches to: a Java regex that begins with ``regex``. Such rules are redacted first.
    whole: str = ""


# The base kinds, in their order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# A key reaches from BEGIN to the next END if no other marker lies between. Without that END it reaches over header lines and the base64 after them:
# long runs, however they are broken, and whole lines. All loops are possessive, so a long key takes no stack.
_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_BREAK = r"(?:\r?\n|\r|\\r\\n|\\n)"
_CLOSED = r"[^-]*+(?:-(?!----(?:BEGIN|END)\x20)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
_HEADERS = rf"(?:[ \t]*{_BREAK}[ \t]*[A-Z][A-Za-z0-9-]*:\x20[^\r\n\\]*+)*+"
_RUNS = r"(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{16,}+)*+"
_LINES = rf"(?:[ \t]*{_BREAK}[ \t]*[A-Za-z0-9+/=]++(?=[ \t]*(?:{_BREAK}|\z)))*+"
# Public formats of further credentials.
EXTRA = (
    Rule("pem", _PEM, whole=rf"{_PEM}(?:{_CLOSED}|{_HEADERS}{_RUNS}{_LINES})"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + EXTRA
#: More alternatives than this are not multiplied out.
MOST = 24


def trigram_query(regex: str, any_case: bool = False) -> list[list[list[str]]]:
    """The Boolean trigram query that every match satisfies, as an AND of ORs of ANDs of trigrams; empty if there is none.

    Literal pieces of the regex are multiplied out while they have few alternatives; what can repeat or has many forms
    ends a piece. A piece gives a condition if all its alternatives have three characters or more.
    """
    found: list[list[list[str]]] = []

    def flush(exact: set[str]) -> None:
        if exact and all(len(x) >= 3 for x in exact):
            found.append(sorted(sorted({x[i : i + 3] for i in range(len(x) - 2)}) for x in exact))

    def exact_of(node) -> set[str] | None:
        """All strings that a node can match, if they are few."""
        op, arg = node
        if op is rc.LITERAL:
            return {chr(arg).lower() if any_case else chr(arg)}
        if op is rc.IN and all(o is rc.LITERAL for o, _ in arg) and len(arg) <= MOST:
            return {chr(a).lower() if any_case else chr(a) for _, a in arg}
        if op is rc.SUBPATTERN:
            return sequence_of(arg[-1])
        if op is rc.BRANCH:
            all_ = [sequence_of(x) for x in arg[1]]
            return None if None in all_ else set().union(*all_)
        if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1 and (one := sequence_of(arg[2])) is not None:
            return one | {""}
        return None

    def sequence_of(nodes) -> set[str] | None:
        have = {""}
        for x in nodes:
            one = exact_of(x)
            if one is None or len(have) * len(one) > MOST:
                return None
            have = {a + b for a in have for b in one}
        return have

    have = {""}
    for node in rp.parse(regex):
        one = exact_of(node)
        if one is None or len(have) * len(one) > MOST:
            flush(have)
            have = one or {""}
            if one is None and node[0] in (rc.MAX_REPEAT, rc.MIN_REPEAT):
                have = {""}
        else:
            have = {a + b for a in have for b in one}
    flush(have)
    return found


def dictionary(rules: tuple[Rule, ...]) -> list[tuple[str, bool]]:
    """The trigrams that the rules' queries ask for, and whether in lower-cased texts; their places are their numbers in the postings."""
    return sorted({(t, r.any_case) for r in rules for one in trigram_query(r.regex, r.any_case) for alt in one for t in alt})


def occurring(text: Column, lowered: Column, rules: tuple[Rule, ...]) -> Column:
    """Numbers of the trigrams of the dictionary that occur in a text. The text in lower case is given by name, as it is asked many times."""
    on = {False: text, True: lowered}
    return F.array_compact(F.array(*(F.when(F.contains(on[low], F.lit(t)), F.lit(i)) for i, (t, low) in enumerate(dictionary(rules)))).cast("array<int>"))


def answers(rule: Rule, posted: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether a text with the posted trigrams satisfies the rule's query; true if it has none."""
    number = {x: i for i, x in enumerate(dictionary(rules))}
    has = lambda t: F.array_contains(posted, F.lit(number[t, rule.any_case]))
    every = lambda xs: reduce(lambda a, b: a & b, xs)
    some = lambda xs: reduce(lambda a, b: a | b, xs)
    query = trigram_query(rule.regex, rule.any_case)
    return every([some([every([has(t) for t in alt]) for alt in one]) for one in query]) if query else F.lit(True)


def postings(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """trigram, doc_id, text_hash: the inverted index, one row for each trigram of the dictionary and text (doc_id, text, text_hash) that has it."""
    # explode() would put a filter of the whole expression under what makes the text
    texts = texts.select("doc_id", "text_hash", "text", F.lower("text").alias("lowered"))
    posted = texts.select("doc_id", "text_hash", F.explode_outer(occurring(F.col("text"), F.col("lowered"), rules)).alias("trigram"))
    return posted.select("trigram", "doc_id", "text_hash").filter("trigram is not null")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """_d, _h, asked: doc_id and text_hash of the texts that answer the query of some rule, and the numbers of these rules. The postings of a query's
    trigrams are intersected by grouping them by text; no more than the dictionary comes together there, copies fall together before the shuffle."""
    posted = index.groupBy("doc_id", "text_hash").agg(F.collect_set("trigram").alias("posted"))
    asked = F.array_compact(F.array(*(F.when(answers(r, F.col("posted"), rules), F.lit(k)) for k, r in enumerate(rules) if trigram_query(r.regex, r.any_case))).cast("array<int>"))
    return posted.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), asked.alias("asked")).filter(F.size("asked") > 0)


def tightened(rule: Rule) -> str:
    """The regex of a rule. One that is a run of a character class, perhaps after letters of that class, can ask for the least length itself: what
    is too short then has no longer match inside."""
    m = re.fullmatch(r"([A-Za-z0-9]*)(\[[^\]]+\])\+", rule.regex)
    if m and not rule.group and not rule.any_case and not rule.whole and rule.least > len(m[1]) and re.fullmatch(f"{m[2]}*", m[1]):
        return f"{m[1]}{m[2]}{{{rule.least - len(m[1])},}}"
    return rule.whole or rule.regex


def _java(rule: Rule) -> str:
    return ("(?i)" if rule.any_case else "") + tightened(rule)


_HIT = "array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>"


def _hits(k: int, rule: Rule, wanted: Column) -> Column:
    """Array of (kind, i, gap, len, ok): the matches of a rule from left to right, and the code points between them; none unless ``wanted``."""
    gaps = F.split("text", _java(rule), -1)
    both = F.zip_with(gaps, F.regexp_extract_all("text", F.lit(_java(rule)), 0), lambda g, m: F.struct(F.char_length(g).alias("gap"), m.alias("m")))
    if rule.group:
        both = F.zip_with(both, F.regexp_extract_all("text", F.lit(_java(rule)), rule.group), lambda b, g: F.struct(b["gap"].alias("gap"), b["m"].alias("m"), g.alias("g")))
    checked = lambda b: b["g"] if rule.group else b["m"]
    hits = F.transform(both, lambda b, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), b["gap"].alias("gap"), F.char_length(b["m"]).alias("len"), (F.char_length(checked(b)) >= rule.least).alias("ok")))
    found = F.when(wanted & F.col("text").rlike(_java(rule)), F.filter(hits, lambda h: h["len"].isNotNull()))
    return F.coalesce(found, F.array().cast(_HIT))


def _matches(texts: DataFrame, rules: list[tuple[int, Rule]], wanted: Column | None = None) -> DataFrame:
    """doc_id, text_hash, hits: of the rules, those only that ``wanted``, an array of numbers, has."""
    each = [_hits(k, r, F.lit(True) if wanted is None else F.array_contains(wanted, k)) for k, r in rules]
    return texts.select("doc_id", "text_hash", F.concat(F.array().cast(_HIT), *each).alias("hits"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text_hash, found (array of (start, kind number, end), sorted): one row per row of ``docs``.

    Offsets are code points, end exclusive; leftmost non-overlapping matches of each kind by itself, then those that are too
    short are dropped. A private key is one span from its BEGIN to its END, or to the end of its base64 where END is missing.
    Offsets are running sums over the matches of a text, so a text with very many matches takes time in proportion.

    The postings are written, then the candidates' keys; these are broadcast to the texts if they are few, else joined by a shuffle,
    and texts that are no candidates go on to the rules without trigrams only. Copies of a text fall together in each task
    before anything of theirs is shuffled. Null and empty texts have no matches. Null doc_id is a key like any other; repeated rows
    give repeated results. Other columns are not read; an empty table gives no rows.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    numbered = list(enumerate(rules))
    indexed = [(k, r) for k, r in numbered if trigram_query(r.regex, r.any_case)]
    rows = _matches(texts, [x for x in numbered if x not in indexed]).withColumn("scanned", F.lit(1))
    if indexed:
        index = table(postings(texts, rules), "postings")
        chosen = table(candidates(index, rules), "candidates")
        drop(index)
        near = F.broadcast(chosen) if fits(chosen, F.coalesce(F.octet_length(F.col("_d").cast("string")), F.lit(0)) + 4 * F.size("asked") + 32) else chosen
        verified = texts.join(near, texts["doc_id"].eqNullSafe(near["_d"]) & (texts["text_hash"] == near["_h"]))
        rows = rows.unionByName(_matches(verified, indexed, F.col("asked")).withColumn("scanned", F.lit(0)))
    # of copies, the hits are the same: one stands for all
    one = lambda x: F.coalesce(F.first(F.when(x, F.col("hits")), True), F.array().cast(_HIT))
    rows = rows.groupBy("doc_id", "text_hash").agg(F.sum("scanned").alias("copies"), one(F.col("scanned") == 1).alias("a"), one(F.col("scanned") == 0).alias("b"))
    hits = rows.select("doc_id", "text_hash", "copies", F.explode_outer(F.concat("a", "b")).alias("h")).select("doc_id", "text_hash", "copies", "h.*")
    order = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order).cast("int"))
    span = F.when(F.col("ok"), F.struct((F.col("end") - F.col("len")).alias("start"), "kind", "end"))
    per = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(span)).alias("found"), F.max("copies").alias("copies"))
    return per.select("doc_id", "text_hash", "found", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def describe(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda k: F.element_at(F.array(*(F.lit(r.kind) for r in rules)), k + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret replaced by ``mark``, kind after kind in the order of the rules, but first those that reach on from their regex, as another
    kind could cut them; all columns are kept, null and empty texts stay as they are, repeated rows and an empty table too. Each row carries its own postings, as
    every text goes on and none need be fetched by its key: nothing is shuffled. A rule whose query they don't answer leaves the text alone; what is
    replaced takes trigrams away and adds none that a rule asks for. A mark that a later kind would match is not used: it has brackets, which no kind matches."""
    ordered = sorted(rules, key=lambda r: not r.whole)

    def one(rule: Rule, hit: Column) -> Callable[[Column], Column]:
        return lambda t: F.when(hit & t.rlike(_java(rule)), _marked(t, rule, mark)).otherwise(t)

    def replaced(posted: Column) -> Column:
        text = F.col("text")
        for rule in ordered:
            text = _bound(text, one(rule, answers(rule, posted, rules)))
        return text

    return docs.withColumn("text", _bound(F.lower("text"), lambda low: _bound(occurring(F.col("text"), low, rules), replaced)))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value bound to a name, as each mention of it would repeat its whole expression."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _marked(text: Column, rule: Rule, mark: str) -> Column:
    pieces = F.split(text, _java(rule), -1)
    whole = F.regexp_extract_all(text, F.lit(_java(rule)), 0)
    group = F.regexp_extract_all(text, F.lit(_java(rule)), rule.group)
    kept = F.zip_with(whole, group, lambda m, g: F.when(F.char_length(g) >= rule.least, F.lit(mark)).otherwise(m))
    return F.array_join(F.flatten(F.zip_with(pieces, kept, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")
