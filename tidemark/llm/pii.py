"""Personal data: base patterns plus candidates chosen by boosted trees, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import landed

KINDS = ("email", "ip", "card", "phone")

# The base patterns of the contract. Runs are possessive and start at their first character, which gives
# the same leftmost matches in one pass over any text; a card match of another length is dropped anyway.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![0-9])(?![ -][0-9])",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_IP_OK = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"

# High-recall generators: spelled-out mail addresses, foreign separators, numbers without a country code.
_AT = r"(?:@|\s?[\[({]\s?(?i:at)\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?(?i:dot)\s?[\])}]\s?)"
CANDIDATES = (
    rf"[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}",
    r"(?<![0-9.])[0-9]{1,4}(?:(?:\[\.\]|[.,])[0-9]{1,4}){3}(?![0-9])",
    r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9]){12,18}(?![0-9])",
    r"(?<![0-9])[+(]{0,2}[0-9](?:[ ().-]{0,3}[0-9]){6,14}(?![0-9])",
)
# words that announce a kind, by kind
_WORDS = (
    r"(?i)(mail|contact|kontakt|correo|courriel)",
    r"(?i)(\bips?\b|\bhosts?\b|hostname|server|addr)",
    r"(?i)(\bcards?\b|\bvisa\b|mastercard|amex|karten?\b|\bcartes?\b|tarjeta)",
    r"(?i)(\btel\b|telef|t[eé]l[eé]ph|\bphone|\bcall|\bmobil|\bfax|\bhandy|whatsapp)",
)

# (name, number of values): a candidate's features are small numbers packed into one code, so the
# distinct codes are bounded by the product of the sizes, whatever the corpus
FEATURES = (("kind", 4), ("digits", 21), ("marks", 5), ("tail", 6), ("letters", 3), ("left", 4), ("right", 4), ("word", 2))
_SPAN = "array<struct<kind:int,lo:int,hi:int,m:string>>"


def _located(text: Column, pattern: str, kind: int, when: Column) -> Column:
    """Matches with code-point positions: the gaps between matches give the starts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    spans = F.aggregate(pairs, start, lambda acc, x: F.struct(
        (acc["at"] + x["g"] + F.length(x["m"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), (acc["at"] + x["g"]).alias("lo"), (
            acc["at"] + x["g"] + F.length(x["m"])).alias("hi"), x["m"].alias("m")))).cast(_SPAN).alias("out")), lambda acc: acc["out"])
    return F.when(when, spans).otherwise(F.array().cast(_SPAN))


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    def value(i):
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _n_digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


def base_spans(text: Column) -> Column:
    """The valid base matches, by kind and start."""
    digit = text.rlike("[0-9]")
    email = _located(text, BASE[0], 0, F.contains(text, F.lit("@")))
    ip = F.filter(_located(text, BASE[1], 1, digit), lambda x: x["m"].rlike(_IP_OK))
    card = F.filter(_located(text, BASE[2], 2, digit), lambda x: _luhn(x["m"]))
    phone = F.filter(_located(text, BASE[3], 3, F.contains(text, F.lit("+"))), lambda x: _n_digits(x["m"]).between(8, 15))
    return F.concat(email, ip, card, phone)


def _by_kind(kind: Column, values) -> Column:
    out = F.when(kind == 0, values[0])
    for k, value in enumerate(values[1:], 1):
        out = out.when(kind == k, value)
    return out


def _masked(x: Column) -> Column:
    """The candidate without what tells near forms from base forms: spelled-out marks, foreign dots, the plus sign."""
    m = x["m"]
    plain = F.regexp_replace(F.regexp_replace(m, _AT, "@"), _DOT, ".")
    return _by_kind(x["kind"], (plain, F.replace(m, F.lit("[.]"), F.lit(".")), m, F.replace(m, F.lit("+"), F.lit(""))))


def _left(text: Column, x: Column) -> Column:
    return F.substr(text, F.greatest(x["lo"] - 20, F.lit(0)) + 1, F.least(x["lo"], F.lit(20)))


def _word(text: Column, x: Column) -> Column:
    left = _left(text, x)
    return _by_kind(x["kind"], [left.rlike(w) for w in _WORDS])


def _valid(text: Column, x: Column) -> Column:
    """The contract's checks, without its marks: a named top domain, byte values, Luhn sum, 8 to 15 digits; numbers stand free."""
    around = F.substr(text, F.greatest(x["lo"], F.lit(1)), F.when(x["lo"] > 0, 1).otherwise(0)), F.substr(text, x["hi"] + 1, F.lit(4))
    free = ~around[0].rlike(r"[\p{L}0-9]") & ~around[1].rlike(r"^[\p{L}0-9]")
    octets = F.replace(_masked(x), F.lit(","), F.lit(".")).rlike(_IP_OK) & ~around[1].rlike(r"^(\[\.\]|[.,])[0-9]") & ~_left(text, x).rlike(r"[0-9](\[\.\]|[.,])$")
    return _by_kind(x["kind"], (
        _masked(x).rlike(r"\.[A-Za-z]{2,}$"), free & octets, free & _luhn(x["m"]), free & _n_digits(x["m"]).between(8, 15)))


def _evidence(text: Column, x: Column) -> Column:
    """What speaks for a valid candidate besides its form: commas may be a list and digits any number, so those need a word or a plus."""
    always = F.lit(True)
    return _by_kind(x["kind"], (always, ~F.contains(x["m"], F.lit(",")) | _word(text, x), always, F.contains(x["m"], F.lit("+")) | _word(text, x)))


def _char_class(c: Column) -> Column:
    return F.when(F.trim(c) == "", 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)


def _code(text: Column, x: Column) -> Column:
    m = _masked(x)
    letters = F.least(F.floor(3 * F.length(F.regexp_replace(m, r"[^\p{L}]", "")) / F.length(m)), F.lit(2))
    values = (
        x["kind"], F.least(_n_digits(m), F.lit(20)), F.least(F.length(F.regexp_replace(m, r"[\p{L}0-9]", "")), F.lit(4)),
        F.least(F.length(F.regexp_extract(m, "([0-9]*)[^0-9]*$", 1)), F.lit(5)),
        F.when(x["kind"] == 1, F.contains(m, F.lit(",")).cast("int")).otherwise(letters),  # addresses have no letters, but may have commas
        _char_class(F.right(_left(text, x), F.lit(1))), _char_class(F.substr(text, x["hi"] + 1, F.lit(1))),
        F.when(_word(text, x), 1).otherwise(0))
    code = F.lit(0).cast("long")
    for (_, size), value in zip(FEATURES, values):
        code = code * size + value
    return code


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and coded candidates of every row, these with their validity, their label and whether they meet a base span.

    The label (``sure``) does not hang on the base forms: a valid candidate with evidence for its kind has it too.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    digit, at = text.rlike("[0-9]"), text.rlike(r"@|[\[({]\s?(?i:at)\s?[\])}]")
    found = rows.withColumn("base", base_spans(text)).withColumn("raw", F.concat(*[
        _located(text, pattern, kind, at if kind == 0 else digit) for kind, pattern in enumerate(CANDIDATES)]))
    coded = F.transform("raw", lambda x: F.struct(
        x["kind"].alias("kind"), x["lo"].alias("lo"), x["hi"].alias("hi"), _code(text, x).alias("code"),
        _valid(text, x).alias("valid"), (_valid(text, x) & _evidence(text, x) | F.exists(
            "base", lambda b: (b["kind"] == x["kind"]) & (b["lo"] < x["hi"]) & (x["lo"] < b["hi"]))).alias("sure"),
        F.exists("base", lambda b: (b["lo"] < x["hi"]) & (x["lo"] < b["hi"])).alias("meets")))
    slim = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["lo"].alias("lo"), b["hi"].alias("hi")))
    return found.select("row", "doc_id", slim.alias("base"), coded.alias("cands"))


def _unpacked(code: int) -> tuple[int, ...]:
    out = []
    for _, size in reversed(FEATURES):
        code, value = divmod(code, size)
        out.append(value)
    return tuple(reversed(out))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _best_split(cells, grads):
    """The cut (feature, value) with the largest gain over all cells, or None."""
    total_g, total_h = sum(g for g, _ in grads), sum(h for _, h in grads)
    best = (1e-6, None)
    for f, (_, size) in enumerate(FEATURES):
        gs, hs = [0.0] * size, [0.0] * size
        for (values, _, _), (g, h) in zip(cells, grads):
            gs[values[f]] += g
            hs[values[f]] += h
        g = h = 0.0
        for cut in range(size - 1):
            g, h = g + gs[cut], h + hs[cut]
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g ** 2 / (total_h + 1)
            if gain > best[0]:
                best = (gain, (f, cut))
    return best[1]


def boost(cells, trees: int = 24, rate: float = 0.4):
    """Second-order boosting of depth-two trees on (feature values, positives, count) cells."""
    pos, n = sum(c[1] for c in cells), sum(c[2] for c in cells)
    bias = math.log((pos + 1) / (n - pos + 1))
    score, model = [bias] * len(cells), []

    def leaf(part, grads):
        g, h = sum(grads[i][0] for i in part), sum(grads[i][1] for i in part)
        return -rate * g / (h + 1)

    for _ in range(trees):
        grads = []
        for s, (_, p, k) in zip(score, cells):
            q = _sigmoid(s)
            grads.append((k * q - p, k * q * (1 - q)))
        top = _best_split(cells, grads)
        if top is None:
            break
        tree = [top]
        for side in (True, False):
            part = [i for i, c in enumerate(cells) if (c[0][top[0]] <= top[1]) == side]
            cut = _best_split([cells[i] for i in part], [grads[i] for i in part])
            if cut is None:
                value = leaf(part, grads)
                tree.append((None, value, value))
            else:
                low = [i for i in part if cells[i][0][cut[0]] <= cut[1]]
                high = [i for i in part if cells[i][0][cut[0]] > cut[1]]
                tree.append((cut, leaf(low, grads), leaf(high, grads)))
        model.append(tree)
        score = [s + _leaf_of(tree, c[0]) for s, c in zip(score, cells)]
    return bias, model


def _leaf_of(tree, values) -> float:
    (f, cut), low, high = tree
    inner, below, above = low if values[f] <= cut else high
    return below if inner is None or values[inner[0]] <= inner[1] else above


def score_of(model, values) -> float:
    total = model[0]
    for tree in model[1]:  # plain additions in the column's order, so a score at a threshold is equal to it in both
        total = total + _leaf_of(tree, values)
    return total


def _score_column(model, code: Column) -> Column:
    """The same sum of trees as a column expression over the packed code."""
    features, step = [None] * len(FEATURES), 1
    for f in range(len(FEATURES) - 1, -1, -1):
        features[f] = F.floor(code / step) % FEATURES[f][1]
        step *= FEATURES[f][1]

    def branch(part):
        inner, below, above = part
        return F.lit(below) if inner is None else F.when(features[inner[0]] <= inner[1], below).otherwise(above)

    total = F.lit(model[0])
    for (f, cut), low, high in model[1]:
        total = total + F.when(features[f] <= cut, branch(low)).otherwise(branch(high))
    return total


def thresholds(model, held, precision: float) -> list[float]:
    """Per kind the lowest score at which held-out candidates are right in ``precision`` of cases.

    Scores are pooled to falling shares first (adjacent violators), so the many base forms at the top do not
    carry wrong ones at the bottom; all above the threshold together must hold the precision too, counted with
    one right and one wrong more.
    """
    out = []
    for kind in range(len(KINDS)):
        levels = {}
        for v, p, n in held:
            if v[0] == kind:
                level = levels.setdefault(score_of(model, v), [0, 0])
                level[0], level[1] = level[0] + p, level[1] + n
        pools = []  # (lowest score, right, all), from the highest score down
        for s, (p, n) in sorted(levels.items(), reverse=True):
            pools.append((s, p, n))
            while len(pools) > 1 and pools[-1][1] * pools[-2][2] >= pools[-2][1] * pools[-1][2]:
                (s, p, n), (_, q, m) = pools.pop(), pools.pop()
                pools.append((s, p + q, n + m))
        at, pos, count = math.inf, 0, 0
        for s, p, n in pools:
            pos, count = pos + p, count + n
            if p >= precision * n and (pos + 1) / (count + 2) >= precision:
                at = s
        out.append(at)
    return out


def fit_selector(found: DataFrame, precision: float = 0.95):
    """Boosted trees over all candidates of the corpus; a fifth of the rows calibrates the thresholds.

    Candidates are counted per feature code first, so what reaches the driver is bounded by the feature
    sizes. The label is ``sure`` of ``scan``; the features hide what tells near forms from base forms.
    Only valid candidates can be added, so only they are calibrated on; nine numbers that fail the Luhn sum
    stand for one that passes it by chance.
    """
    held = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) == 0
    rows = found.select(held.alias("held"), F.explode("cands").alias("c")).groupBy("held", "c.code").agg(
        F.count_if("c.sure").alias("pos"), F.count_if(F.col("c.sure") | F.col("c.valid")).alias("open"), F.count("*").alias("n")).collect()
    fit = sorted((_unpacked(r["code"]), r["pos"], r["n"]) for r in rows if not r["held"])
    if not fit:
        return None
    tried = sorted((_unpacked(r["code"]), r["pos"], r["open"], r["n"]) for r in rows if r["held"] and r["open"])
    tried = [(v, max(0.0, p - (n - m) / 9) if v[0] == 2 else p, m) for v, p, m, n in tried]
    model = boost(fit)
    return model, thresholds(model, tried, precision)


def _spans(base: Column, cands: Column, selector) -> tuple[Column, Column]:
    """Base spans, and base plus chosen spans, each ordered by kind and start."""
    slim = lambda x: F.struct(x["kind"].alias("kind"), x["lo"].alias("lo"), x["hi"].alias("hi"))
    own = F.array_sort(base)
    if selector is None:
        return own, own
    model, cuts = selector
    def chosen(x):
        least = F.element_at(F.array(*[F.lit(float(c)) for c in cuts]), (x["kind"] + 1).cast("int"))
        return ~x["meets"] & x["valid"] & (_score_column(model, x["code"]) >= least)
    return own, F.array_sort(F.concat(base, F.transform(F.filter(cands, chosen), slim)))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["lo"].cast("string"), x["hi"].cast("string"))), ",")


def _count_of(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def find_pii(docs: DataFrame, precision: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data, one row per row of ``docs``.

    Base spans always stay. A valid candidate that meets no base span is added where the trees score it above
    its kind's calibrated threshold. Returns doc_id, counts of base spans per kind, base_spans and spans
    as text, and both as arrays. Null text counts as empty; texts without data have empty spans; repeated
    rows are scanned each for itself; extra columns are not read; no rows give no rows.
    """
    found = landed(scan(docs, id_col, text_col), "pii")
    own, every = _spans(F.col("base"), F.col("cands"), fit_selector(found, precision))
    counts = [_count_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("row", "doc_id", *counts, own.alias("base"), every.alias("every")).select(
        "doc_id", *[f"n_{k}" for k in KINDS], _joined(F.col("base")).alias("base_spans"), _joined(F.col("every")).alias("spans"),
        F.col("every").alias("span_list"))


def redacted(text: Column, span_list: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one mark."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    order = F.array_sort(F.transform(span_list, lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(order, start, lambda acc, x: F.struct(
        F.greatest(acc["at"], x["hi"]).alias("at"),
        F.when(x["lo"] < acc["at"], acc["out"]).otherwise(F.concat(
            acc["out"], F.substr(text, acc["at"] + 1, x["lo"] - acc["at"]), F.element_at(names, x["kind"] + 1))).alias("out")))
    return F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))
