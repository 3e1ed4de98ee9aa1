"""Personal data in texts: strict rules, and boosted trees over what looser patterns propose, in DataFrame expressions only.

Four kinds: email, ip, card, phone.  The base rules are fixed patterns with a check each (parts up to 255, Luhn, number of
digits); their spans always stay.  High-recall generators propose further, overlapping spans: written-out or spaced
addresses, addresses of version 6, digits with any separators.  Each gets features of its format and of the words
around it; gradient boosted trees score it; spans whose score reaches the kind's threshold and that touch no base span are
added, of overlapping ones the best.

The trees are fitted on ``EXAMPLES`` labelled texts that this module writes out (formats of personal data and of
numbers that are none, with and without cue words), never on the documents, so they are the same for every input.
One half fits, the other sets the thresholds: the least score from which on ``PRECISION`` of the candidates are right.
Fitted trees become nested conditions of one column expression: scoring needs no model, join or shuffle.

Positions are code points, ends exclusive.  Patterns find leftmost matches that do not overlap; where a piece of text is
read again and again by the plain form of a pattern, it is guarded so that time stays linear.

Edge cases: null and empty texts have no spans (counts 0, the digest of nothing, an empty string); rows are judged
one by one, so repeated rows and ids give a row each; in very long texts only the number of added spans counts more than
linearly.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import texts

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 4000
ROUNDS, DEPTH = 16, 4
PRECISION = 0.995
NEAR = 32

# The base patterns.  Guards and possessive repeats find what the plain forms find, without going back.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: What a text must hold for a base rule to have a span in it; quick to look for.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
# Looser patterns, several for a kind, each with what a text must hold for it.
_LOCAL, _LABEL, _OPEN, _CLOSE = r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++", r"[\p{L}0-9-]++", r"\s?[(\[{<]\s?", r"\s?[)\]}>]\s?"
LOOSE = (
    ("email", "[@＠]", rf"(?i){_LOCAL}\s?[@＠]\s?{_LABEL}(?:(?:\.|\s\.\s){_LABEL})*+"),
    ("email", r"[(\[{<]\s?[Aa][Tt]\s?[)\]}>]", rf"(?i){_LOCAL}{_OPEN}at{_CLOSE}{_LABEL}(?:(?:\.|{_OPEN}dot{_CLOSE}|\sdot\s){_LABEL})++"),
    ("email", r"\s[Dd][Oo][Tt]\s", rf"(?i){_LOCAL}\sat\s{_LABEL}(?:\sdot\s{_LABEL})++"),
    ("ip", r"[0-9]\s?[.\[(](?:dot|\.)?[\])]?\s?[0-9]", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\)|\[dot\])\s?[0-9]{1,3}){3}+(?![0-9A-Za-z])"),
    ("ip", r":[0-9A-Fa-f]{0,4}:", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("card", r"[0-9](?:[\x20\u00A0._/-]{0,3}[0-9]){11}", r"(?<![0-9A-Za-z])[0-9](?:(?:[\x20\u00A0._/-]|\x20-\x20)?[0-9]){11,18}+(?![0-9A-Za-z])"),
    ("card", "[0-9]{12}", r"(?<![0-9A-Za-z])[0-9]{12,19}+(?![0-9A-Za-z])"),
    ("phone", r"[0-9](?:[\x20\u00A0().\-/]{0,3}[0-9]){6}", r"(?<![0-9A-Za-z+])(?:\+|\(\+?)?[0-9](?:[\x20\u00A0().\-/]{0,3}[0-9]){6,14}+(?![0-9A-Za-z])"),
)
# Words in front of personal data, by kind, and words in front of other numbers.
CUES = {
    "email": ("mail", "e-mail", "contact", "write", "schreib", "kontakt", "courriel", "correo", "escrib"),
    "ip": ("ip", "host", "server", "login", "client", "address", "adresse"),
    "card": ("card", "visa", "master", "amex", "karte", "carte", "tarjeta", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp", "ruf", "handy", "appel", "llam"),
}
OTHER = ("order", "invoice", "isbn", "version", "id", "ref", "no", "nr", "page", "section", "serial", "total", "price", "date", "ticket", "build")
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "ch", "at", "us")
FEATURES = (
    "kind", "digits", "groups", "longest", "shortest", "size", "luhn", "octets", "colons", "gap6", "plus", "brackets", "separators", "cue", "other", "glued",
    "at_words", "dot_words", "sign", "ending", "dots",
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, block: int = 256) -> Column:
    """Sums of an array's first 1, 2, ... values; blocks keep the copies of growing arrays short."""
    grow = lambda start, part: F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    blocks = lambda v: F.transform(F.sequence(F.lit(1), F.size(v), F.lit(block)), lambda i: F.slice(v, i, block))

    def summed(parts):
        total = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x))
        starts = F.slice(grow(F.lit(0), total), 1, F.size(parts))
        return F.flatten(F.zip_with(parts, starts, lambda part, start: F.slice(grow(start, part), 2, F.size(part))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(blocks(v), summed)).otherwise(F.array().cast("array<int>")))


SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def found(text: Column, pattern: str, needed: str) -> Column:
    """Every match with its place and the text near it, in texts that hold what is needed for one."""
    pieces = F.split(text, pattern, -1)

    def placed(p):
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

        def spans(h):
            lengths = F.zip_with(F.slice(p, 1, F.size(h)), h, lambda a, b: F.length(a) + F.length(b))
            return F.transform(
                F.arrays_zip(_running(lengths).alias("end"), h.alias("match"), F.slice(p, 1, F.size(h)).alias("before"), F.slice(p, 2, F.size(h)).alias("after")),
                lambda x: F.struct(
                    (x["end"] - F.length(x["match"])).alias("start"), x["end"].alias("end"), x["match"].alias("match"),
                    F.right(x["before"], F.lit(NEAR)).alias("before"), F.left(x["after"], F.lit(NEAR)).alias("after"),
                ),
            )

        return F.when(F.size(p) > 1, _let(hits, spans)).otherwise(F.array().cast(SPAN))

    there = text.contains(needed) if len(needed) == 1 else text.rlike(needed)
    return F.when(there, _let(pieces, placed)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether 12 to 19 digits have the right check digit."""

    def checked(d):
        doubled = lambda v: v * 2 - F.when(v > 4, 9).otherwise(0)
        value = lambda i: F.ascii(F.substring(d, F.length(d) - i + 1, F.lit(1))) - 48
        total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
        return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(False)

    return _let(_digits(match), checked)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the base rules by kind and start: ``kind`` (its place in ``KINDS``), ``start``, ``end``."""

    def of(k: int, kind: str) -> Column:
        valid = F.filter(found(text, BASE[kind], NEEDED[kind]), lambda x: _valid(kind, x["match"]))
        return F.transform(valid, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return F.concat(*(of(k, kind) for k, kind in enumerate(KINDS)))


def _has(text: Column, words: tuple[str, ...], whole: bool = False) -> Column:
    some = "|".join(words)
    return text.rlike(rf"(?:^|[^\p{{L}}])(?:{some}){r'(?![\p{L}])' if whole else ''}").cast("int")


def _features(k: int, kind: str, x: Column) -> Column:
    """The features of one proposed span, all whole numbers."""
    match, low, before = x["match"], F.lower(x["match"]), F.lower(x["before"])
    near = F.substring_index(before, "\n", -1)
    runs = F.transform(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0)), lambda r: F.length(r))
    flag = lambda c: c.cast("int")
    separators = F.size(F.array_distinct(F.split(F.regexp_replace(match, r"[\p{L}0-9+]", ""), "")))
    last_words = F.regexp_extract(near, r"((?:\S+\s+){0,2}\S*\s*)$", 1)
    glued = flag(x["before"].rlike(r"[\p{L}0-9./:-]$")) + flag(x["after"].rlike(r"^(?:[\p{L}0-9/:-]|[.,][0-9])"))
    zero = F.lit(0)
    values = {
        "kind": F.lit(k),
        "digits": F.length(_digits(match)),
        "groups": F.size(runs),
        "longest": F.coalesce(F.array_max(runs), zero),
        "shortest": F.coalesce(F.array_min(runs), zero),
        "size": F.length(match),
        "luhn": flag(luhn(match)) if kind == "card" else zero,
        "octets": flag(F.regexp_replace(match, r"[^0-9]+", ".").rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")) if kind == "ip" else zero,
        "colons": F.length(F.regexp_replace(match, "[^:]", "")),
        "gap6": flag(match.contains("::")),
        "plus": flag(match.rlike(r"^\(?\+")) + flag(match.rlike(r"^\(?00")),
        "brackets": flag(match.contains("(")),
        "separators": separators,
        "cue": _has(last_words, CUES[kind]),
        "other": _has(last_words, OTHER, whole=True),
        "glued": glued,
        "at_words": flag(low.rlike(r"[^\p{L}]at[^\p{L}]")),
        "dot_words": flag(low.rlike(r"[^\p{L}]dot[^\p{L}]")),
        "sign": flag(match.rlike("[@＠]")),
        "ending": flag(low.rlike(rf"[^\p{{L}}](?:{'|'.join(ENDINGS)})$")),
        "dots": F.length(F.regexp_replace(match, r"[^.]", "")),
    }
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), *(values[f].cast("int").alias(f) for f in FEATURES))


def proposed(text: Column) -> Column:
    """What the generators find, with features; spans may overlap and some are proposed twice."""
    of = lambda kind, needed, pattern: F.transform(found(text, pattern, needed), lambda x: _features(KINDS.index(kind), kind, x))
    return F.concat(*(of(*rule) for rule in LOOSE))


def _luhn_end(r: random.Random, n: int, right: bool) -> str:
    head = "".join(str(r.randrange(10)) for _ in range(n - 1))
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(head)))
    check = -total % 10
    return head + str(check if right else (check + r.randrange(1, 10)) % 10)


def examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[int, str, int, int, int]]:
    """``example, text, kind, start, end``: a kind of -1 marks a text whose numbers and signs are nothing personal."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ba", "re", "ti", "lo", "nun", "sch", "ei", "der", "qua", "ño", "és", "mor")) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(str(r.randrange(10)) for _ in range(k))
    ascii_word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 8)))
    octet = lambda: str(r.randrange(256))
    hexes = lambda k: ":".join(f"{r.randrange(1 << 16):x}" for _ in range(k))

    def grouped(text: str, sizes: tuple[int, ...], mark: str) -> str:
        cuts = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
        return mark.join(text[a:b] for a, b in zip(cuts, cuts[1:]))

    def personal(kind: str) -> tuple[str, float]:
        """A value, and how often a cue word stands in front of it."""
        end = r.choice(ENDINGS)
        user, host = ascii_word() + r.choice(("", "." + ascii_word(), str(r.randrange(99)))), ascii_word()
        if kind == "email":
            at, dot = r.choice(((" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."), ("＠", "."), ("@", "."), ("{at}", ".")))
            name = word() + "é" if at == "@" else user
            return f"{name}{at}{host}{dot}{end}", 0.5
        if kind == "ip":
            mark = r.choice((".", "[.]", "[.]", "(.)", " . ", "[dot]"))
            return (mark.join(octet() for _ in range(4)), 0.4) if r.random() < 0.6 else (r.choice((hexes(8), hexes(r.randint(2, 4)) + "::" + hexes(r.randint(1, 2)))), 0.4)
        if kind == "card":
            sizes, n_digits = r.choice((((4, 4, 4, 4), 16), ((4, 6, 5), 15), ((4, 4, 4, 1), 13), ((16,), 16), ((15,), 15), ((4, 4, 4, 4, 3), 19)))
            return grouped(_luhn_end(r, n_digits, True), sizes, r.choice((" ", "-", ".", " ", "/", " - "))), 0.6
        a, b, c = str(r.randrange(2, 10)) + digits(2), digits(3), digits(4)
        form = r.randrange(8)
        plain = (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{digits(2)} {digits(4)} {c}", f"0{digits(3)}/{digits(7)}", f"00{r.randrange(30, 99)} {a} {digits(7)}", f"(+{r.randrange(1, 99)}) {a} {b} {c}", f"0{r.randrange(1, 9)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}")
        return plain[form], 0.5 if form in (0, 5, 6) else 0.85

    def other() -> tuple[str, float]:
        """A value that is not personal, and how often a word for other numbers stands in front of it."""
        k = r.randrange(16)
        y, m, d = r.randrange(1950, 2030), r.randrange(1, 13), r.randrange(1, 29)
        return (
            (_luhn_end(r, r.choice((13, 15, 16, 16, 16, 19)), False), 0.3),
            (grouped(_luhn_end(r, 16, False), (4, 4, 4, 4), r.choice((" ", "-", "."))), 0.3),
            (f"{y}-{m:02}-{d:02}", 0.2),
            (f"{d:02}.{m:02}.{y} {r.randrange(24):02}:{r.randrange(60):02}:{r.randrange(60):02}", 0.2),
            (f"{r.randrange(24):02}:{r.randrange(60):02}:{r.randrange(60):02}", 0.1),
            (digits(r.randint(7, 12)), 0.7),
            (f"978-{r.randrange(10)}-{digits(2)}-{digits(6)}-{r.randrange(10)}", 0.6),
            (f"{y}-{y + r.randrange(1, 9)} {y + 10}-{y + 15}", 0.1),
            (f"{r.randrange(1, 900)} {digits(3)} {digits(3)}", 0.3),
            (".".join(str(r.choice((r.randrange(256, 999), r.randrange(300)))) for _ in range(3)) + f".{r.randrange(256, 999)}", 0.3),
            (f"{r.randrange(20)}.{r.randrange(20)}.{r.randrange(20)}.{r.randrange(20)}.{r.randrange(20)}", 0.8),
            (f"{ascii_word()}@{ascii_word()}", 0.1),
            (f"{r.randrange(90)} @ {r.randrange(90)}.{digits(2)}", 0.2),
            (":".join(f"{r.randrange(256):02x}" for _ in range(6)), 0.2),
            (f"{r.randrange(90)}.{digits(4)} {r.randrange(90)}.{digits(4)}", 0.2),
            (f"{digits(3)}-{digits(2)}-{digits(4)}-{digits(5)}", 0.6),
        )[k]

    out = []
    for k in range(n):
        kind = r.randrange(2 * len(KINDS)) - len(KINDS)
        value, often = personal(KINDS[kind]) if kind >= 0 else other()
        head = [word() for _ in range(r.randint(0, 6))]
        if r.random() < often:
            head.append(r.choice(CUES[KINDS[kind]] if kind >= 0 else OTHER) + r.choice(("", ":", " :")))
        start = len(text := "".join(w + " " for w in head))
        out.append((k, text + value + r.choice((" ", ". ", ", ")) + word(), max(kind, -1), start, start + len(value)))
    return out


def labelled(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """Proposed spans of the examples with ``label``; spans that only touch a personal one are left out."""
    schema = "array<struct<example:int,text:string,is:int,from:int,to:int>>"
    written = json.dumps([dict(zip(("example", "text", "is", "from", "to"), x)) for x in examples(n)])
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(written), schema))).repartition(8, "example")
    c = rows.select("example", "is", "from", "to", F.inline(proposed(F.col("text"))))
    right = (F.col("is") == F.col("kind")) & (F.col("from") == F.col("start")) & (F.col("to") == F.col("end"))
    touches = (F.col("is") >= 0) & (F.col("from") < F.col("end")) & (F.col("start") < F.col("to"))
    return c.where(right | ~touches).withColumn("label", right.cast("double"))


def _score(trees: tuple, of: str = "") -> str:
    """The trees' weighted sum in SQL; ``of`` stands before the features' names."""

    def walk(node):
        return f"{node}D" if isinstance(node, float) else f"CASE WHEN {of}{FEATURES[node[0]]} <= {node[1]}D THEN {walk(node[2])} ELSE {walk(node[3])} END"

    return " + ".join(f"{weight}D * {walk(tree)}" for weight, tree in trees)


def _tree(node) -> tuple | float:
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    return int(node.split().featureIndex()), float(node.split().threshold()), _tree(node.leftChild()), _tree(node.rightChild())


@lru_cache(maxsize=4)
def _fitted(n: int) -> tuple[tuple, tuple[float, ...]]:
    """Trees and thresholds by kind, once per driver: they depend on nothing but the number of examples."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled(SparkSession.active(), n).persist()
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.where("example % 2 = 0"))
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(vectors)
    trees = tuple((float(w), _tree(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees))
    scored = rows.where("example % 2 = 1").select("kind", "label", F.expr(_score(trees)).alias("score"))
    down = Window.partitionBy("kind").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    good = scored.withColumn("precision", F.avg("label").over(down)).where(F.col("precision") >= PRECISION)
    least = {r.kind: r.least for r in good.groupBy("kind").agg(F.min("score").alias("least")).collect()}
    rows.unpersist()
    return trees, tuple(least.get(k, float("inf")) for k in range(len(KINDS)))


def _apart(candidates: Column, base: Column) -> Column:
    """The candidates that touch no base span, by start: a pass forward over both and one back, so time is not the product of both."""
    event = lambda x, is_base, score: F.struct(x["start"].alias("start"), F.lit(not is_base).alias("late"), x["end"].alias("end"), x["kind"].alias("kind"), score.alias("score"))
    both = F.array_sort(F.concat(F.transform(base, lambda x: event(x, True, F.lit(0.0))), F.transform(candidates, lambda x: event(x, False, x["score"]))))
    none = F.array().cast("array<struct<start:int,late:boolean,end:int,kind:int,score:double>>")
    state = lambda rows, edge: F.struct(rows.alias("rows"), edge.alias("edge"))

    def forward(acc, x):  # edge: how far the base spans reach
        grown = F.concat(acc["rows"], F.array(x))
        return F.when(~x["late"], state(grown, F.greatest(acc["edge"], x["end"]))).when(x["start"] >= acc["edge"], state(grown, acc["edge"])).otherwise(acc)

    def back(acc, x):  # edge: where the next base span starts
        return F.when(~x["late"], state(acc["rows"], x["start"])).when(x["end"] <= acc["edge"], state(F.concat(acc["rows"], F.array(x)), acc["edge"])).otherwise(acc)

    ahead = F.aggregate(both, state(none, F.lit(0)), forward, lambda acc: F.reverse(acc["rows"]))
    return F.aggregate(ahead, state(none, F.lit((1 << 31) - 1)), back, lambda acc: F.reverse(acc["rows"]))


def _added(candidates: str, base: Column, trees: tuple, thresholds: tuple[float, ...]) -> Column:
    """Proposed spans that reach their threshold and touch no base span; of those that overlap, the best."""
    scored = F.expr(f"transform({candidates}, c -> struct(c.start AS start, c.end AS end, c.kind AS kind, {_score(trees, 'c.')} AS score))")
    least = F.array(*map(F.lit, thresholds))
    high = F.filter(scored, lambda x: x["score"] >= F.get(least, x["kind"]))

    def choose(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        without = F.slice(acc, 1, F.size(acc) - 1)
        return F.when((F.size(acc) == 0) | (x["start"] >= last["end"]), F.concat(acc, F.array(x))).when(x["score"] > last["score"], F.concat(without, F.array(x))).otherwise(acc)

    none = F.array().cast("array<struct<start:int,late:boolean,end:int,kind:int,score:double>>")
    span = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    spans = "array<struct<kind:int,start:int,end:int>>"
    return _let(high, lambda h: F.when(F.size(h) == 0, F.array().cast(spans)).otherwise(F.transform(F.aggregate(_apart(h, base), none, choose), span)))


def _written(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")


def find(spark: SparkSession, docs: DataFrame, n_examples: int = EXAMPLES) -> DataFrame:
    """``doc_id, text, base, spans``: arrays of ``kind, start, end`` by kind and start; ``spans`` holds the base ones too."""
    trees, thresholds = _fitted(n_examples)
    rows = texts(docs)
    text, base = F.col("text"), F.col("base")
    out = rows.withColumn("base", base_spans(text))
    out = out.withColumn("proposed", proposed(text))
    return out.withColumn("spans", F.array_sort(F.concat(base, _added("proposed", base, trees, thresholds)))).drop("proposed")


def redact(found_rows: DataFrame) -> DataFrame:
    """``doc_id, text`` with the spans of ``find`` replaced by their kind in brackets; of overlapping spans the first covers the rest."""
    name = F.array(*map(F.lit, KINDS))
    in_order = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def step(acc, x):
        kept = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        mark = F.when(x["start"] >= acc["at"], F.concat(F.lit("["), F.get(name, x["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.concat(acc["parts"], F.array(kept, mark)).alias("parts"), F.greatest(acc["at"], x["end"]).alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    body = F.aggregate(in_order, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found_rows.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(body).alias("text"))


def digest(found_rows: DataFrame) -> DataFrame:
    """``doc_id``, the number of base spans of each kind, the digest of the base spans, and all spans as ``kind:start:end``."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found_rows.select("doc_id", *map(count, range(len(KINDS))), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
