"""Surrogates for personal data: keyed replacements of the same type, format, script and gender.

A detected value is replaced by one that a keyed hash of it gives, so the same value has the same surrogate in every
document. Parts that are mentioned apart (mail domains, given names, surnames) have surrogates of their own, so partial
mentions still refer to the same person. Rounds over all distinct values of the corpus settle who has which surrogate: those
that two values share, or that are themselves values of the corpus, are drawn again, and get longer where a format is crowded.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import random
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, per_batch

# fixed values: given names by script and gender, titles by gender, and syllables of made-up surnames by script
GIVEN = {
    ("latin", "f"): "Anna Maria Sophie Emma Laura Julia Clara Elena Lucia Carmen Isabel Marie Claire Camille Alice Sarah Emily Jane Mary Susan Linda Patricia Jennifer Elizabeth Karen Nancy Helen".split(),
    ("latin", "m"): "Peter Paul Hans Karl Thomas Martin Lukas Felix Juan Carlos Pablo Miguel Jean Pierre Louis Henri James John Robert Michael William David Richard Joseph Charles George Edward".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Андрей Николай Михаил Владимир Павел".split(),
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f", "Mme": "f", "Señor": "m", "Señora": "f"}
SYLLABLES = {"latin": "ba bel dor fen gar hal jor kel lan mar nel or pen ral sel tan ul van wel zer".split(), "cyrillic": "ба вел гор дан жел зар кол лем мир нов".split()}

_BY_NAME = {n: k for k, names in GIVEN.items() for n in names}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_DIGITS = tuple("0123456789")
#: Detectors; each needs one of the strings before it to be in the text at all.
PATTERNS: list[tuple[str, tuple[str, ...], re.Pattern]] = [
    ("email", ("@",), re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("secret", ("=", ":"), re.compile(r"""(?i)(?<=password)\s*[=:]\s*["']?[^\s"',;]{6,}|(?<=passwd)\s*[=:]\s*["']?[^\s"',;]{6,}|(?<=token)\s*[=:]\s*["']?[^\s"',;]{6,}|(?<=secret)\s*[=:]\s*["']?[^\s"',;]{6,}|(?<=api_key)\s*[=:]\s*["']?[^\s"',;]{6,}""")),
    ("access_key", ("AKIA", "ASIA"), re.compile(r"\bA(?:KIA|SIA)[A-Z0-9]{16}\b")),
    ("iban", _DIGITS, re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("card", _DIGITS, re.compile(r"(?<![\d.])(?:\d[ -]?){12,18}\d(?![\d.]\d)(?!\d)")),
    ("ip", _DIGITS, re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)")),
    ("ipv6", ("::", ":"), re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?=:)|(?=::))[0-9A-Fa-f:]{2,38}(?![\w:]|\.\d)")),
    ("ssn", ("-",), re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", _DIGITS, re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w+])\+\d{8,15}(?!\d)")),
]
_NAME = r"([^\W\d_]+)"
#: Titles and the one or two words after them; a listed given name and the word after it, which may be a given name too.
_TITLED = re.compile(r"\b(?:(?:" + "|".join(TITLES) + r")\.? )+" + _NAME + rf"(?: {_NAME})?")
_GIVEN = re.compile(r"\b(" + "|".join(sorted(_BY_NAME, key=len, reverse=True)) + rf")\b(?= {_NAME})")


_SPOKEN = [t + end for t in TITLES for end in (" ", ". ")]


#: Rounds after which surrogates get longer by a sign a round: where any length will do, and where the format has one length.
LONGER, LONGER_FIXED = 3, 32


def digits_in(text: str) -> bool:
    return any(c in text for c in _DIGITS)


def luhn(digits: str) -> int:
    """The last digit that makes digits + it pass the check of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def is_ipv6(value: str) -> bool:
    try:
        return value.count(":") > 2 and bool(ipaddress.IPv6Address(value))
    except ValueError:
        return False


def iban_check(country: str, account: str) -> str:
    """The two digits by which an account number passes the check of its country's kind: the whole leaves 1 modulo 97."""
    number = "".join(str(int(c, 36)) for c in f"{account}{country}00")
    return f"{98 - int(number) % 97:02d}"


def script_of(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def name_kind(word: str) -> str:
    """Names that are not listed as given names, and so have no known gender, count as surnames."""
    return "given-{}-{}".format(*_BY_NAME[word]) if word in _BY_NAME else "surname"


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the entities of a text, without overlaps: earlier ones first, of those at one place the longer."""
    found = []
    for kind, needs, pattern in PATTERNS:
        if not any(c in text for c in needs) or (kind == "ssn" and not digits_in(text)):
            continue
        for m in pattern.finditer(text):
            start, end, value = m.start(), m.end(), m.group()
            if kind == "secret":  # the value alone, without what assigns it
                start += len(value) - len(value.lstrip(" \t\r\n=:\"'"))
                value = text[start:end]
            if kind == "card":
                digits = re.sub(r"\D", "", value)
                if not 13 <= len(digits) <= 19 or (len(digits) != 16 and luhn(digits[:-1]) != int(digits[-1])):
                    continue
            if kind == "ipv6" and not is_ipv6(value):
                continue
            found.append((start, end, kind, value))
    names = []
    for m in _GIVEN.finditer(text) if any(n in text for n in _BY_NAME) else ():
        if m.group(2)[0].isupper() and m.group(2) not in TITLES:
            names += [(m.start(g), m.end(g), name_kind(m.group(g)), m.group(g)) for g in (1, 2)]
    for m in _TITLED.finditer(text) if any(t in text for t in _SPOKEN) else ():
        for g in (1, 2):
            if not m.group(g) or not m.group(g)[0].isupper() or m.group(g) in TITLES:
                break
            names.append((m.start(g), m.end(g), name_kind(m.group(g)), m.group(g)))
    known = {v for _, _, _, v in names}
    if known:  # mentions of the given name or the surname alone
        for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + r")\b", text):
            names.append((m.start(), m.end(), name_kind(m.group()), m.group()))
    out, upto = [], 0
    for x in sorted({*found, *names}, key=lambda x: (x[0], -x[1], x[2])):
        if x[0] >= upto:
            out.append(x)
            upto = x[1]
    return out


class Keyed:
    """Numbers that a key and a value give, again and again the same."""

    def __init__(self, key: bytes, kind: str, value: str, turn: int):
        self.seed, self.n, self.pool = hmac.new(key, f"{kind}\0{value}\0{turn}".encode(), hashlib.sha256).digest(), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < n << 32:
            self.pool = int.from_bytes(hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest(), "big")
            self.n, self.left = self.n + 1, 1 << 256
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out


@lru_cache(maxsize=1 << 12)
def letters_like(c: str) -> str:
    """Letters of the same case from the same 256 code points: those of its script."""
    first = ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(first, first + 256)) if unicodedata.category(x) == unicodedata.category(c))


def reshaped(value: str, r: Keyed, longer: int = 0) -> str:
    """Digits and letters are replaced by others of their kind, case and script; all else stays, unless there is nothing but that."""
    out, changed = [], False
    for c in value:
        if c.isdigit():
            out.append(str(r.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + r.below(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + r.below(26)))
        elif c.isalpha():
            like = letters_like(c)
            out.append(like[r.below(len(like))])
        else:
            out.append(c)
            continue
        changed = True
    if not changed:
        out = [chr(97 + r.below(26)) for _ in value]
    last = next((c for c in reversed(out) if c.isalnum()), "a")
    digit, capital = last.isdigit(), "A" <= last <= "Z"
    return "".join(out + [str(r.below(10)) if digit else chr((65 if capital else 97) + r.below(26)) for _ in range(longer)])


@lru_cache(maxsize=64)
def permuted(key: bytes, script: str, gender: str) -> dict[str, str]:
    """A keyed permutation of the names of one script and gender that keeps none in place: distinct names stay distinct."""
    names = list(GIVEN[script, gender])
    order = names[:]
    random.Random(hmac.new(key, f"{script}{gender}".encode(), hashlib.sha256).hexdigest()).shuffle(order)
    return {a: order[(i + 1) % len(order)] for i, a in enumerate(order)}


@lru_cache(maxsize=1 << 16)
def surrogate(key: bytes, kind: str, value: str, turn: int = 0, domain_turn: int = 0) -> str:
    """The replacement of a value at its turn-th collision, and for mail addresses that of its domain."""
    if kind.startswith("given-"):
        _, script, gender = kind.split("-")
        return permuted(key, script, gender)[value]
    r, longer, fixed = Keyed(key, kind, value, turn), max(0, turn - LONGER), max(0, turn - LONGER_FIXED)
    if kind == "domain":
        host, _, top = value.rpartition(".")
        return f"{reshaped(host, r, longer)}.{top}"
    if kind == "email":
        local, _, domain = value.partition("@")
        return f"{reshaped(local, r, longer)}@{surrogate(key, 'domain', domain.lower(), domain_turn)}"
    if kind == "card":
        digits = [c for c in value if c.isdigit()]
        new = digits[0] + "".join(str(r.below(10)) for _ in digits[1:-1])
        check = luhn("".join(digits[:-1])) == int(digits[-1])
        put = iter(new + (str(luhn(new)) if check else str(r.below(10))))
        return "".join(next(put) if c.isdigit() else c for c in value) + "".join(str(r.below(10)) for _ in range(fixed))
    if kind == "ip":
        return ".".join(str(1 + r.below(254)) for _ in range(4)) if not fixed else "2001:db8" + "".join(f":{r.below(1 << 16):x}" for _ in range(6))
    if kind == "phone":
        code = re.match(r"\+\d{1,3}(?=[ .(-])", value)
        keep = code.end() if code else 0
        return value[:keep] + reshaped(value[keep:], r, fixed)
    if kind == "access_key":
        return value[:4] + reshaped(value[4:], r, fixed)
    if kind == "iban":
        plain = value.replace(" ", "")
        new = value[:2] + reshaped(value[2:], r, fixed)
        if iban_check(plain[:2], plain[4:]) == plain[2:4]:  # only what passed the check passes it afterwards
            new = new[:2] + iban_check(new[:2], new[4:].replace(" ", "")) + new[4:]
        return new
    if kind == "ipv6":
        new = "2001:db8" + "".join(f":{r.below(1 << 16):x}" for _ in range(6))
        return new.upper() if value.isupper() else new
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", value):
        return "".join("0123456789abcdef"[r.below(16)] for _ in range(len(value) + longer))
    if kind == "surname":
        s = SYLLABLES[script_of(value)]
        word = "".join(s[r.below(len(s))] for _ in range(2 + r.below(2) + turn // 2))
        return word.upper() if value.isupper() and len(value) > 1 else word.capitalize()
    return reshaped(value, r, longer if kind == "secret" else fixed)


def found_values(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [(i, k, v) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for _, _, k, v in detect(t or "") if not k.startswith("given-")]
    rows += [(i, "domain", v.partition("@")[2].lower()) for i, k, v in rows if k == "email"]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["id", "kind", "value"])


def named(key: bytes, turn: int):
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        k, v, d = (batch.column(i).to_pylist() for i in range(3))
        new = pa.array([surrogate(key, a, b, turn, c) for a, b, c in zip(k, v, d, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, new], ["kind", "value", "domain_turn", "surrogate"])

    return per_batch(f)


def settled(values: DataFrame, scratch: Scratch, key: bytes) -> DataFrame:
    """(kind, value, turn, domain_turn) of the values that do not keep their first surrogates.

    values: distinct (kind, value, domain_turn). A round draws for those still without: the smallest value that drew a surrogate
    has it for good, unless it is a value of its kind or was given out before. Rounds go on until none is left; as surrogates
    get longer, each round has far more of them than values.
    """
    left = scratch.keep(values)
    given, moved, turn = left.select("kind", F.col("value").alias("surrogate")), left.withColumn("turn", F.lit(0)).limit(0), 0
    while True:
        drawn = scratch.keep(left.mapInArrow(named(key, turn), "kind string, value string, domain_turn int, surrogate string"))
        owners = scratch.keep(drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).join(given, ["kind", "surrogate"], "left_anti"))
        has = drawn.join(owners, ["kind", "value", "surrogate"], "left_semi")
        if turn:
            moved = moved.unionAll(has.select("kind", "value", "domain_turn", F.lit(turn).alias("turn")))
        left = scratch.keep(drawn.join(owners, ["kind", "value", "surrogate"], "left_anti").select("kind", "value", "domain_turn"))
        if left.isEmpty():
            return moved.select("kind", "value", "turn", "domain_turn")
        given, turn = given.unionAll(owners.select("kind", "surrogate")), turn + 1


def replaced(key: bytes):
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts, kinds = [], [], []
        for text, turns in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found = detect(text) if text else []
            turn = {(x["kind"], x["value"]): x["turn"] for x in turns or []}
            out, upto = [], 0
            for start, end, kind, value in found:
                of_domain = turn.get(("domain", value.partition("@")[2].lower()), 0) if kind == "email" else 0
                out += [text[upto:start], surrogate(key, kind, value, turn.get((kind, value), 0), of_domain)]
                upto = end
            texts.append("".join([*out, text[upto:]]) if found else text)
            counts.append(len(found))
            kinds.append(",".join(sorted({k.split("-")[0] for _, _, k, _ in found})))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], ["id", "text", "n_pii", "kinds"])

    return per_batch(f, "text")


def surrogates(docs: DataFrame, scratch: Scratch, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_pii (entities replaced) and kinds (their types, sorted) of every row.

    The same key gives the same surrogates; distinct values of a kind, mail domains too, have distinct ones, none of which is a
    value of that kind in the corpus; given names are exchanged among the listed ones instead. Where a format has too few free
    places (one-letter local parts of a domain), surrogates are longer than their values. Null texts stay null; rows that repeat an id, and those whose id is null, are treated like any others. Other
    columns are dropped. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = scratch.keep(docs.where("text is not null").mapInArrow(per_batch(found_values, "text"), "id long, kind string, value string"))
    is_domain = F.col("kind") == "domain"
    domains = scratch.keep(settled(found.where(is_domain).select("kind", "value").distinct().withColumn("domain_turn", F.lit(0)), scratch, key))
    of_domain = F.when(F.col("kind") == "email", F.lower(F.substring_index("value", "@", -1)))
    turns = domains.select(F.col("value").alias("domain"), F.col("turn").alias("moved"))
    values = found.where(~is_domain).select("kind", "value").distinct().withColumn("of", of_domain)
    values = values.join(turns, F.col("of") == F.col("domain"), "left").select("kind", "value", F.coalesce("moved", F.lit(0)).alias("domain_turn"))
    moved = scratch.keep(domains.unionAll(settled(values, scratch, key)).select("kind", "value", "turn"))
    if not moved.isEmpty():
        late = found.join(moved, ["kind", "value"]).groupBy("id").agg(F.collect_set(F.struct("kind", "value", "turn")).alias("turns")).withColumnRenamed("id", "of")
        docs = docs.join(late, F.col("id").eqNullSafe(F.col("of")), "left").select("id", "text", "turns")
    else:
        docs = docs.withColumn("turns", F.lit(None).cast("array<struct<kind: string, value: string, turn: int>>"))
    return docs.mapInArrow(replaced(key), "id long, text string, n_pii long, kinds string").withColumnRenamed("id", id_col)
