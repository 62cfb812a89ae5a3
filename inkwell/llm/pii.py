"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select.

All of it is DataFrame expressions. Generators propose spans that may overlap: a base one for email, ip, card and phone,
whose matches always stand if they pass their check, and wide ones with high recall for what the base forms miss (written-out
addresses, IPv6, national phone numbers, bank and account numbers, national ids, keys and tokens). Wide proposals are decided
by gradient boosted trees over format features (digits, length, separators, mix of characters, a checksum) and context
features (neighbouring characters, a cue word before the span).

The tables hold no labelled spans, so the trees learn from examples made by rule: sentences with spans of known kind in the
forms in use, and look-alikes (dates, times, versions, ISBNs, long words, paths, prices, long numbers that have neither
a cue nor a checksum) that must stay. Half of
the examples teach the trees; on the others the least margin is sought from which on at least `PRECISION` of a generator's
proposals are right. A wide proposal counts as right where it covers a span of its kind, whatever its checksum says: the
checksum is a feature among others. As neither depends on the corpus, a text has the same spans in any table, and one pass
over the texts is enough.

Places are code points, ends exclusive. A proposal within a base span is left out; added spans may overlap one another and
reach over base ones. Null texts count as empty and have no spans, as do empty ones; an empty table gives an empty result.
Rows that repeat a doc_id are searched each for itself, equal texts have equal spans. Long texts take time in proportion to
their length. `redact` keeps all further columns, whatever their names.
"""

from __future__ import annotations

import math
import random
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain_names

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "id", "account")
# The contract's base patterns, written so that java.util.regex needs neither recursion nor a new start inside a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: Wide generators: kind, pattern, and a cheap pattern that any text with a match has.
WIDE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?)[A-Za-z0-9-]++)++", r"(?i)at\x20?[\])}]"),
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20(?i:at)\x20[A-Za-z0-9-]++(?:\x20(?i:dot)\x20[A-Za-z0-9-]++)++", r"(?i)\x20at\x20[a-z0-9-]++\x20dot\x20"),
    ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", r":[0-9A-Fa-f]{0,4}:"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[./][0-9]{4}){2}[./][0-9]{1,7}(?![0-9])", r"[0-9]{4}[./][0-9]{4}"),
    ("phone", r"(?<![0-9+(])\(?[0-9]{2,5}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]\)?[\x20.-][0-9]{3}[\x20.-]"),
    ("phone", r"(?<![0-9+])0[0-9]{2,4}[\x20/-][0-9]{5,8}(?![0-9])", r"0[0-9]{2,4}[\x20/-][0-9]"),
    ("secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9])", r"[0-9]"),
    ("secret", r"(?<=[=:\x20\"'])(?<=(?i:token|secret|passwd|password|pwd|key|auth)[\"']{0,1}\x20{0,2}[=:]\x20{0,2}[\"']{0,1})[A-Za-z0-9_!#$%&*+./@^~-]{6,}+", r"[a-zA-Z\"']\x20{0,2}[=:]\x20{0,2}[\"']{0,1}[A-Za-z0-9]"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    ("id", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}-[0-9]{2}-"),
    ("account", r"(?<![0-9A-Za-z.,+_-])[0-9]{8,19}(?![0-9A-Za-z_]|[.,-][0-9])", r"[0-9]{8}"),
)
#: Cue words by what they announce.
CUES = (
    r"(?i)(?:mail|contact|write|tel|phone|call|fax|mobil|ip|addr|host|server|kontakt|correo|courriel|llam)",
    r"(?i)(?:card|visa|credit|pay|iban|account|acct|konto|cuenta|compte|ssn|social|passport|customer|member|nr\.|no\.)",
    r"(?i)(?:token|secret|passw|pwd|key|auth|bearer|credential)",
)
NEAR = 24
CHUNK = 128
ROUNDS, RATE, PRECISION, EXAMPLES = 80, 0.4, 0.95, 4700
#: Each feature's number of values.
LEVELS = {"maker": len(WIDE), "digits": 7, "length": 6, "sep": 6, "mix": 5, "variety": 3, "check": 2, "before": 4, "after": 4, "cue": 4}


def _let(value: Column, f) -> Column:
    """f of a value that is computed once: inside a lambda an outer expression would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _placed(text: Column, pattern: str) -> Column:
    """array<struct<start,end,hit,before,after>> of the leftmost non-overlapping matches, by the lengths of what lies between them."""
    empty = F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>")
    size = lambda s: s["gap"] + F.length(s["hit"])

    def step(gaps: Column, h: Column, i: Column) -> Column:
        before, after = F.get(gaps, i), F.get(gaps, i + 1)
        return F.struct(F.length(before).alias("gap"), h.alias("hit"), F.substring(before, -NEAR, NEAR).alias("before"), F.substring(after, 1, NEAR).alias("after"))

    def fold(part: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), empty.alias("out"))
        one = lambda a, s: F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + size(s)).alias("end"), s["hit"].alias("hit"), s["before"].alias("before"), s["after"].alias("after"))
        return F.aggregate(part, start, lambda a, s: F.struct((a["at"] + size(s)).alias("at"), F.concat(a["out"], F.array(one(a, s))).alias("out")), lambda a: a["out"])

    def places(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + size(s)))
        return _let(sums, lambda n: F.flatten(F.transform(chunks, lambda c, i: fold(c, F.aggregate(F.slice(n, 1, i), F.lit(0), lambda a, x: a + x)))))

    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    steps = _let(found, lambda p: F.transform(p["hits"], lambda h, i: step(p["gaps"], h, i)))
    # In chunks, since each fold copies what it has: a text with many matches takes time in proportion to them.
    chunks = _let(steps, lambda st: F.transform(F.sequence(F.lit(0), F.size(st), F.lit(CHUNK)), lambda k: F.slice(st, k + 1, CHUNK)))
    return _let(chunks, places)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    value = lambda i: F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 1, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, hit: Column) -> Column:
    """The check of a base span."""
    n = F.length(_digits(hit))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(hit, r"\."), lambda p: F.when(F.length(short(p)) <= 3, short(p).cast("int") <= 255).otherwise(False))
    return F.lit(True)


def _mod97(hit: Column) -> Column:
    """Whether a bank number's check digits are right."""
    plain = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).when(c != "", a * 100 + F.ascii(c) - 55).otherwise(a) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _check(kind: str, hit: Column) -> Column:
    if kind in ("card", "account"):
        return _luhn(_digits(hit))
    return _mod97(hit) if kind == "iban" else F.lit(False)


def _side(char: Column) -> Column:
    return F.when(char.rlike(r"[\s]"), 0).when(char.rlike(r"\p{L}"), 1).when(char.rlike("[0-9]"), 2).when(char == "", 0).otherwise(3)


def _bucket(value: Column, *bounds: int) -> Column:
    return reduce(lambda e, i: F.when(value < bounds[i], i).otherwise(e), reversed(range(len(bounds))), F.lit(len(bounds)))


def _cell(maker: int, s: Column) -> Column:
    """All features of a wide proposal as one number."""
    hit, kind = s["hit"], WIDE[maker][0]
    n, letters = F.length(_digits(hit)), F.length(F.regexp_replace(hit, "[^A-Za-z]", ""))
    one_case = (F.lower(hit) == hit) | (F.upper(hit) == hit)
    found = {
        "maker": F.lit(maker),
        "digits": _bucket(n, 1, 4, 9, 11, 14, 17),
        "length": _bucket(F.length(hit), 8, 16, 24, 32, 48),
        "sep": F.when(hit.contains(" "), 1).when(hit.contains(":"), 2).when(hit.contains("/"), 3).when(hit.contains("."), 4).when(hit.rlike("[-_]"), 5).otherwise(0),
        "mix": F.when(letters == 0, 0).when(n == 0, 1).when(n * 8 < letters, 2).when(one_case, 3).otherwise(4),
        "variety": _bucket(F.size(F.array_distinct(F.split(F.substring(hit, 1, 64), ""))), 5, 10),
        "check": _check(kind, hit).cast("int"),
        "before": _side(F.substring(s["before"], -1, 1)),
        "after": _side(F.substring(s["after"], 1, 1)),
        "cue": F.when(s["before"].rlike(CUES[2]), 3).when(s["before"].rlike(CUES[1]), 2).when(s["before"].rlike(CUES[0]), 1).otherwise(0),
    }
    return reduce(lambda cell, name: cell * LEVELS[name] + found[name], LEVELS, F.lit(0).cast("long"))


def _matches(text: Column, pattern: str, gate: str, made) -> Column:
    none = F.array().cast("array<struct<kind:int,start:int,end:int,maker:int,cell:bigint>>")
    return F.when(text.rlike(gate) & text.rlike(pattern), made(_placed(text, pattern))).otherwise(none)


def _span(kind: str, maker: int, cell: Column, s: Column) -> Column:
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(maker).alias("maker"), cell.cast("long").alias("cell"))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, maker, cell>> of the base spans that pass their checks."""
    def of(kind: str) -> Column:
        made = lambda found: F.transform(F.filter(found, lambda s: _passes(kind, s["hit"])), partial(_span, kind, -1, F.lit(-1)))
        return _matches(text, BASE[kind], BASE_GATE[kind], made)

    return F.concat(*map(of, BASE))


def wide_spans(text: Column) -> Column:
    """The same of all wide proposals, with the number of their features."""
    def of(maker: int) -> Column:
        kind, pattern, gate = WIDE[maker]
        return _matches(text, pattern, gate, lambda found: F.transform(found, lambda s: _span(kind, maker, _cell(maker, s), s)))

    return F.concat(*map(of, range(len(WIDE))))


def _values(cell: int) -> list[int]:
    out = []
    for n in reversed(LEVELS.values()):
        cell, v = divmod(cell, n)
        out.append(v)
    return out[::-1]


def _made_number(rng: random.Random, n: int, luhn: bool | None = None) -> str:
    digits = [rng.randint(1, 9)] + [rng.randint(0, 9) for _ in range(n - 1)]
    if luhn is not None:
        total = lambda: sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        digits[-1] = (digits[-1] - total()) % 10 if luhn else (digits[-1] - total() + 1 + rng.randint(0, 8)) % 10
    return "".join(map(str, digits))


def _made_iban(rng: random.Random) -> str:
    country, rest = rng.choice(["DE", "FR", "ES", "GB", "NL", "IT"]), _made_number(rng, rng.choice([14, 18, 20]))
    spelled = int(rest + "".join(str(ord(c) - 55) for c in country) + "00")
    plain = f"{country}{98 - spelled % 97:02d}{rest}"
    return " ".join(plain[i : i + 4] for i in range(0, len(plain), 4)) if rng.random() < 0.5 else plain


def _forms(rng: random.Random) -> list[tuple[str | None, str]]:
    """One of each form: (kind, text) of a span, (None, text) of a look-alike; `cue: ` may stand before the text, cut off by a bar."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    low, hexed, both = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    name, host, number = pick(low, rng.randint(3, 8)), pick(low, rng.randint(3, 9)), partial(_made_number, rng)
    secret = rng.choice(["token", "secret", "password", "api_key", "Authorization", "access key"])
    word = pick(low, rng.randint(18, 34))
    spans = [
        ("email", f"{name}{rng.choice([' [at] ', '[at]', ' (at) ', '(at)'])}{host}{rng.choice([' [dot] ', '[dot]', '.'])}com"),
        ("email", f"{name} at {host} dot com"),
        ("ip", ":".join(pick(hexed, 4) for _ in range(8))),
        ("ip", f"{pick(hexed, 4)}:{pick(hexed, 3)}::{pick(hexed, 4)}"),
        ("card", rng.choice("./").join(number(16, True)[i : i + 4] for i in (0, 4, 8, 12))),
        ("phone", f"({number(3)}) {number(3)}-{number(4)}"),
        ("phone", f"call |{rng.choice('-. ').join([number(3), number(3), number(4)])}"),
        ("phone", f"0{number(3)}{rng.choice(' /-')}{number(rng.randint(6, 8))}"),
        ("secret", f'{secret} = "|{pick(hexed, rng.choice([32, 40, 64]))}'),
        ("secret", f"{secret}: |{pick(both, rng.randint(20, 48))}"),
        ("secret", f"{secret}=|{pick(both, rng.randint(8, 15))}{rng.choice('!#$7')}"),
        ("secret", pick(hexed, rng.choice([32, 40, 64])).replace("a", "7")),
        ("secret", f"{rng.choice(['AKIA', 'ghp_', 'sk-', 'xoxb-'])}{pick(both, rng.randint(20, 40))}"),
        ("iban", _made_iban(rng)),
        ("iban", f"IBAN |{_made_iban(rng)}"),
        ("id", f"{rng.choice(['SSN |', 'social security no. |', ''])}{number(3)}-{number(2)}-{number(4)}"),
        ("account", number(rng.randint(14, 19), True)),
        ("account", f"{rng.choice(['account no. |', 'Konto |', 'customer |', 'passport |'])}{number(rng.randint(9, 19))}"),
    ]
    year = rng.randint(1900, 2030)
    alike = [
        f"{year}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", f"{year}{rng.randint(10, 12)}{rng.randint(10, 28)}",
        f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}", f"ISBN |978{number(10)}", f"version |{number(1)}.{number(1)}.{number(2)}", f"{number(3)},{number(3)},{number(3)}.{number(2)}",
        word, f"{word}-{pick(low, 8)}", f"{pick(low, 6)}_{pick(low, 7)}_{pick(low, 5)}", f"/{pick(low, 5)}/{pick(low, 8)}/{pick(low, 6)}", f"{pick(low, 8)}/{pick(low, 9)}/index", word.upper(),
        "-" * rng.randint(16, 60), "_" * rng.randint(16, 60), "0" * rng.randint(8, 19), f"{pick(low, 12)}{number(2)}{pick(low, 6)}", f"{number(rng.randint(8, 11))}", number(rng.randint(14, 19), False), f"1{number(9)}", f"{year}-{year + 3}",
        f"page |{number(3)} {number(3)} {number(4)}", f"ratio {number(2)}:{number(2)}:{number(2)}", f"meet me at {name} dot {host}"[8:].replace(" dot ", " and "), f"key: |{pick(low, 7)}", f"the key = |{pick(low, 9)}", f"order |{number(8)}",
        f"{pick(both, 6)}-{pick(low, 4)}-{pick(low, 4)}-{pick(low, 5)}", f"https://{host}.com/{word}/{pick(low, 10)}",
    ]
    return spans + [(None, a) for a in alike]


def examples(n: int = EXAMPLES, seed: int = 11) -> list[tuple[int, str, str | None, int, int]]:
    """n sentences made by rule: number, text, and the kind, start and end of the span in it (None: a look-alike)."""
    rng, out = random.Random(seed), []
    prose = "the of and a to in die der und que les dans por para with from this one".split()
    while len(out) < n:
        for kind, form in _forms(rng):
            cue, bar, hit = form.rpartition("|")
            ahead = " ".join(rng.choice(prose) for _ in range(rng.randint(4, 9))) + rng.choice([" ", " ", "\n", ": "]) + cue
            behind = rng.choice(['"', "", ".", ","]) if bar else rng.choice(["", ".", ",", "!!"])
            out.append((len(out), f"{ahead}{hit}{behind} {rng.choice(prose)} {rng.choice(prose)}", kind, len(ahead), len(ahead) + len(hit)))
    return out[:n]


def boost(cells: list[tuple[list[int], float, float]], rounds: int = ROUNDS) -> tuple[float, list]:
    """Boosted trees of two levels on (feature values, proposals, right ones): a bias, and (feature, value), ((feature, value), yes, no) of both sides per tree."""
    names = list(LEVELS)
    total, good = sum(c[1] for c in cells), sum(c[2] for c in cells)
    bias = math.log((good + 1) / (total - good + 1))
    margin = [bias] * len(cells)
    tests = [(f, v) for f, name in enumerate(names) for v in range(LEVELS[name])]

    def stump(rows: list[int], grad: list[float], hess: list[float]):
        g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
        best = (1e-9, None, g / (h + 1), g / (h + 1))
        sums = {}
        for i in rows:
            for f, v in enumerate(cells[i][0]):
                a = sums.setdefault((f, v), [0.0, 0.0])
                a[0] += grad[i]
                a[1] += hess[i]
        for test in tests:
            if test in sums:
                g1, h1 = sums[test]
                gain = g1 * g1 / (h1 + 1) + (g - g1) ** 2 / (h - h1 + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, test, g1 / (h1 + 1), (g - g1) / (h - h1 + 1))
        return best

    trees = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad = [c[2] - c[1] * q for c, q in zip(cells, p, strict=True)]
        hess = [c[1] * q * (1 - q) for c, q in zip(cells, p, strict=True)]
        _, top, _, _ = stump(range(len(cells)), grad, hess)
        if top is None:
            break
        sides = []
        for want in (True, False):
            rows = [i for i, c in enumerate(cells) if (c[0][top[0]] == top[1]) == want]
            _, test, yes, no = stump(rows, grad, hess)
            yes, no = RATE * yes, RATE * no
            for i in rows:
                margin[i] += yes if test and cells[i][0][test[0]] == test[1] else no
            sides.append((test, yes, no))
        trees.append((top, sides))
    return bias, trees


def margin_of(model: tuple[float, list], values: list[int]) -> float:
    bias, trees = model
    for top, sides in trees:
        test, yes, no = sides[values[top[0]] != top[1]]
        bias += yes if test and values[test[0]] == test[1] else no
    return bias


def _margin(model: tuple[float, list], cell: str) -> str:
    """The same as SQL on a cell's number: one text, since a Column of 80 trees is thousands of calls to the JVM."""
    below, unit = {}, 1
    for f in reversed(range(len(LEVELS))):
        below[f] = (unit, list(LEVELS.values())[f])
        unit *= below[f][1]
    is_ = lambda t: f"{cell} div {below[t[0]][0]} % {below[t[0]][1]} = {t[1]}"
    side = lambda s: f"CASE WHEN {is_(s[0])} THEN {s[1]!r}D ELSE {s[2]!r}D END" if s[0] else f"{s[2]!r}D"
    return " + ".join([f"{float(model[0])!r}D", *(f"CASE WHEN {is_(top)} THEN {side(a)} ELSE {side(b)} END" for top, (a, b) in model[1])])


def fit(spark: SparkSession) -> dict:
    """Trees and each generator's least margin, from the examples made by rule."""
    made = spark.createDataFrame(examples(), "number long, text string, kind string, start int, end int").select("number", "kind", "start", "end", F.explode(_built("wide", lambda: wide_spans(F.coalesce("text", F.lit(""))))).alias("p"))
    right = (F.element_at(F.array(*map(F.lit, KINDS)), F.col("p.kind") + 1) == F.col("kind")) & (F.col("p.start") <= F.col("start") + 1) & (F.col("p.end") >= F.col("end") - 1)
    counted = made.groupBy((F.xxhash64("number") % 2 == 0).alias("half"), F.col("p.cell").alias("cell")).agg(F.count("*").alias("n"), F.sum(F.coalesce(right, F.lit(False)).cast("long")).alias("good"))
    rows = counted.collect()  # EXAMPLES rows at most, whatever the corpus
    model = boost([(_values(r.cell), r.n, r.good) for r in rows if r.half])
    least = []
    for maker in range(len(WIDE)):
        mine = sorted(((margin_of(model, _values(r.cell)), r.n, r.good) for r in rows if not r.half and _values(r.cell)[0] == maker), reverse=True)
        n = good = 0
        cut = mine[0][0] if mine else 0.0
        for k, (m, a, b) in enumerate(mine):
            n, good = n + a, good + b
            if good >= PRECISION * n and (k + 1 == len(mine) or mine[k + 1][0] < m):
                cut = m
        least.append(cut)
    return {"trees": model, "least": least}


_FITTED: dict[str, dict] = {}
_BUILT: dict[tuple, Column] = {}


def _built(name: str, make) -> Column:
    """An expression over fixed column names, built once for each JVM: that takes many calls to it, and seconds."""
    from pyspark import SparkContext

    key = (name, id(SparkContext._gateway))
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def model_of(spark: SparkSession) -> dict:
    """The model, fitted once a process: it depends on nothing but this module."""
    if not _FITTED:
        _FITTED["model"] = fit(spark)
    return _FITTED["model"]


def chosen_spans(model: dict) -> Column:
    """Of the column pii_wide the proposals that the thresholds select, but for those within a span of pii_base."""
    cuts = ", ".join(f"{float(x)!r}D" for x in model["least"])
    return F.expr(f"""array_distinct(transform(filter(pii_wide, p -> NOT exists(pii_base, b -> b.start <= p.start AND p.end <= b.end)
      AND {_margin(model["trees"], "p.cell")} >= get(array({cuts}), p.maker) - 1e-9D), p -> struct(p.kind AS kind, p.start AS start, p.end AS end)))""")


def _place(s: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def marked(docs: DataFrame, model: dict) -> DataFrame:
    """docs (with a text column, and none of these names) with pii_base and pii_added, arrays of (kind, start, end)."""
    text = lambda: F.coalesce("text", F.lit(""))
    out = docs.withColumn("pii_base", _built("base", lambda: F.transform(base_spans(text()), _place))).withColumn("pii_wide", _built("wide", lambda: wide_spans(text())))
    return out.withColumn("pii_added", chosen_spans(model)).drop("pii_wide")


def _of(k: int):
    return lambda p: p["kind"] == k


def _line(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> (base spans), base_sha256, spans, n_added and n_spans of each row of docs (doc_id, text)."""
    out = marked(docs.select("doc_id", "text"), model_of(docs.sparkSession))
    counts = [F.size(F.filter("pii_base", _of(KINDS.index(kind)))).cast("long").alias(f"n_{kind}") for kind in BASE]
    sizes = (F.size("pii_added").cast("long").alias("n_added"), (F.size("pii_base") + F.size("pii_added")).cast("long").alias("n_spans"))
    return out.select("doc_id", *counts, F.sha2(_line(F.col("pii_base")), 256).alias("base_sha256"), _line(F.concat("pii_base", "pii_added")).alias("spans"), *sizes)


@plain_names("text")
def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """docs with each selected span of text replaced by its kind in brackets; overlapping spans are replaced as one. Null stays null."""
    spotted = marked(docs, model or model_of(docs.sparkSession))
    base, added = F.col("pii_base"), F.col("pii_added")
    spans = F.array_sort(F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    name = lambda s: F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["kind"] + 1)
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def put(a: Column, s: Column) -> Column:
        ahead = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), name(s))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], ahead).otherwise(a["out"]).alias("out"))

    clean = F.aggregate("pii_spans", first, put, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return spotted.withColumn("pii_spans", spans).withColumn("text", F.when(F.size("pii_spans") > 0, clean).otherwise(text)).select(*docs.columns)
