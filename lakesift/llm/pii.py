"""Personal data: detection, and surrogates in its place.

Every detected entity is replaced by a surrogate of its own type, format and
script (names: also gender), derived from a secret key and the entity's
canonical form.  So one entity has one surrogate wherever it occurs and however
it is written (coreference), in any document and in any run.  Distinctness is
checked over the whole corpus: the distinct entities are a table, surrogates
that meet each other or an entity that really occurs are drawn again, until
none do; a text is rewritten with the attempts that were settled.  The
surrogates of every kind grow in number with the attempt (longer names, longer
values, other ranges of addresses), so no corpus has too many entities for them.

The table of distinct entities is made by partial aggregation, so an entity
with a third of all mentions is no hot key.  Only entities whose first draw
collided travel back to the texts, by a hash of the text.

Edge cases: a null text stays null (and counts no entities), an empty one
empty; overlapping finds: the leftmost, then the first kind in order wins;
repeated rows are rewritten alike; null ids are kept; very long texts are
scanned whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import count
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import on_workers, small_side, staged

# Patterns of the kinds, in order of preference.
KINDS = (
    ("secret", r"\bAKIA[0-9A-Z]{16}\b"),
    ("secret", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("secret", r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?(?P<v>[A-Za-z0-9+/_\-]{8,})[\"']?"),
    ("email", r"\b[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"(?<![\d.\-])(?:\d{4}[ \-]?){3}\d{4}(?![\d\-])"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)"),
    ("phone", r"(?<![\w+])(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}(?!\d)"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
)
# Titles by gender, and given names by script and gender.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Leon", "Martin", "Oscar", "Paul"),
    ("latin", "f"): ("Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Helena", "Irene", "Laura", "Marta", "Nora", "Paula"),
    ("latin", "n"): ("Alex", "Charlie", "Jamie", "Kim", "Robin", "Sascha"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Иван", "Павел"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Ольга"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя"),
}
SYLLABLES = {
    "latin": ("bar", "den", "fel", "gor", "hal", "kin", "lor", "mar", "nel", "por", "ras", "sten", "tor", "vel", "win", "zan"),
    "cyrillic": ("бар", "вел", "гор", "дол", "зар", "кол", "лен", "мир", "нов", "пол", "рад", "сав", "тар", "ход", "чер", "яр"),
}
#: Endings of drawn given names; syllables have none of them, so given names
#: of two genders, and given and family names, never meet.
ENDINGS = {
    ("latin", "m"): "o", ("latin", "f"): "a", ("latin", "n"): "i",
    ("cyrillic", "m"): "ий", ("cyrillic", "f"): "а", ("cyrillic", "n"): "я",
}
#: From this attempt on a value has one more character with each attempt.
LONGER_FROM = 4

_KIND_RE = [(kind, re.compile(p)) for kind, p in KINDS]
_TITLE_RE = re.compile(
    r"(?<!\w)(?P<title>" + "|".join(re.escape(t) for ts in TITLES.values() for t in ts) + r")\.?"
    r"(?P<names>(?: [A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’\-]+){1,3})")
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}


def _script(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def canonical(kind: str, value: str) -> str:
    """What one entity has in common however it is written."""
    if kind in ("card", "ssn", "phone"):
        return "".join(c for c in value if c.isdigit())
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "secret":
        return value
    return value.casefold() if kind.startswith(("given", "family")) else value.lower()


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical) of all entities, in order, not overlapping."""
    found = []
    digits = any(c.isdigit() for c in text)
    for order, (kind, pattern) in enumerate(_KIND_RE):
        if kind == "email" and "@" not in text or kind in ("card", "ssn", "phone", "ip", "iban") and not digits:
            continue
        for m in pattern.finditer(text):
            start, end = m.span("v") if "v" in pattern.groupindex else m.span()
            found.append((start, order, end, kind))
    names: dict[str, str] = {}
    for m in _TITLE_RE.finditer(text):
        words = m["names"].split()
        gender = _GENDER[m["title"]]
        names.setdefault(words[-1], f"family-{_script(words[-1])}")
        for w in words[:-1]:
            names.setdefault(w, f"given-{_script(w)}-{gender}")
    if names:  # all mentions of the names of titled persons
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)", text):
            found.append((m.start(), len(KINDS), m.end(), names[m[0]]))
    out, at = [], 0
    for start, _, end, kind in sorted(found):
        if start >= at:
            out.append((start, end, kind, canonical(kind, text[start:end])))
            at = end
    return out


class Stream:
    """Numbers derived from the key, the entity and the attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed = f"{kind}\x00{value}\x00{attempt}".encode("utf-8", "surrogatepass")
        self.key, self.block, self.held = key, 0, []

    def below(self, n: int) -> int:
        if not self.held:
            digest = blake2b(self.seed + self.block.to_bytes(4, "little"), key=self.key, digest_size=64).digest()
            self.held = [int.from_bytes(digest[i: i + 4], "little") for i in range(0, 64, 4)]
            self.block += 1
        return self.held.pop() % n


def _luhn(digits: list[int]) -> int:
    total = sum(d if i % 2 else (2 * d - 9 if 2 * d > 9 else 2 * d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _longer(attempt: int, since: int = LONGER_FROM) -> int:
    """Characters that a surrogate has more than its entity."""
    return max(0, attempt - since + 1)


def _digits(n: int, s: Stream) -> str:
    return "".join(str(s.below(10)) for _ in range(n))


def _same_shape(value: str, s: Stream, more: int = 0) -> str:
    """Characters of the same classes, and ``more`` of the last one's class
    (letters, if that is neither a letter nor a digit)."""
    last = value[-1:]
    value += (last if last.isascii() and last.isalnum() else "a") * more
    out = []
    for c in value:
        if "0" <= c <= "9":
            out.append(chr(48 + s.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + s.below(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + s.below(26)))
        else:
            out.append(c)
    return "".join(out)


def draw(key: bytes, kind: str, value: str, attempt: int) -> str:
    """Canonical surrogate of a canonical value; never the value itself."""
    s = Stream(key, kind, value, attempt)
    for wider in count(attempt):  # a value may be all there is of its shape
        out = _draw(kind, value, wider, s)
        if out != value:
            return out


def _draw(kind: str, value: str, attempt: int, s: Stream) -> str:
    if kind.startswith("family"):
        script = kind.split("-")[1]
        return "".join(SYLLABLES[script][s.below(16)] for _ in range(2 + s.below(2) + attempt // 4))
    if kind.startswith("given"):
        _, script, gender = kind.split("-")
        names = GIVEN[script, gender]
        if attempt == 0:
            return names[s.below(len(names))].casefold()
        # names that met are drawn from syllables, sixteen times as many with each attempt
        return "".join(SYLLABLES[script][s.below(16)] for _ in range(1 + attempt)) + ENDINGS[script, gender]
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        end = labels[-1] if labels[-1] in ("com", "net", "org") else "com"
        head = ".".join(_same_shape(x, s) for x in labels[:-2])
        # reserved names, so that a surrogate is nobody's address
        return f"{_same_shape(local, s, _longer(attempt))}@{head + '.' if head else ''}example.{end}"
    if kind == "ip" and attempt >= 8:  # an IPv6 address of the range for documentation
        return "2001:db8:" + ":".join(f"{s.below(1 << 16):04x}" for _ in range(6))
    if kind == "ip" and attempt >= 4:  # octets of any width
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "ip":
        return ".".join(str(1 + s.below(9) if len(o) == 1 else 10 + s.below(90) if len(o) == 2 else 100 + s.below(155)) for o in value.split("."))
    if kind == "card":
        digits = [int(value[0])] + [s.below(10) for _ in range(len(value) - 1 + _longer(attempt))]
        if _luhn([int(c) for c in value[:-1]]) == int(value[-1]):
            digits[-1] = _luhn(digits[:-1])
        return "".join(map(str, digits))
    if kind == "phone":
        lead = 1 if len(value) > 10 else 0
        ten = len(value) - lead == 10
        if ten and attempt < 8:  # the exchange that no subscriber has
            area = str(2 + s.below(8)) + str(s.below(10)) + str(s.below(10))
            return value[:lead] + area + "555" + _digits(4, s)
        more = _longer(attempt, 12 if ten else LONGER_FROM)
        return value[:lead] + str(2 + s.below(8)) + _digits(len(value) - lead - 1 + more, s)
    if kind == "ssn":
        return str(900 + s.below(100)) + _digits(len(value) - 3 + _longer(attempt), s)
    if kind == "iban":
        return value[:2] + _same_shape(value[2:], s, _longer(attempt))
    if kind == "secret" and value.startswith("AKIA"):
        return "AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[s.below(32)] for _ in range(len(value) - 4 + _longer(attempt)))
    if kind == "secret" and re.fullmatch("[0-9a-f]+", value):
        return "".join("0123456789abcdef"[s.below(16)] for _ in range(len(value) + _longer(attempt)))
    return _same_shape(value, s, _longer(attempt))


def lay_out(kind: str, original: str, surrogate: str) -> str:
    """The surrogate in the way the original was written."""
    if kind.startswith(("given", "family")):
        if original.isupper():
            return surrogate.upper()
        return "-".join(p[:1].upper() + p[1:] for p in surrogate.split("-")) if original[:1].isupper() else surrogate
    if kind in ("card", "ssn", "phone"):
        rest = iter(surrogate)
        return "".join(next(rest) if c.isdigit() else c for c in original) + "".join(rest)
    if kind == "iban":
        rest = iter(surrogate)
        return "".join(c if c == " " else next(rest) for c in original) + "".join(rest)
    if kind == "email" and len(original) == len(surrogate):
        return "".join(b.upper() if a.isupper() else b for a, b in zip(original, surrogate))
    return surrogate


def rewrite(text: str, key: bytes, attempts: dict[tuple[str, str], int], drawn=draw) -> tuple[str, list[tuple[str, str]]]:
    """The text with surrogates, and its entities (kind, canonical)."""
    out, at, entities = [], 0, []
    for start, end, kind, value in find(text):
        surrogate = drawn(key, kind, value, attempts.get((kind, value), 0))
        out += [text[at:start], lay_out(kind, text[start:end], surrogate)]
        at = end
        entities.append((kind, value))
    return "".join(out) + text[at:], entities


# --- Spark ----------------------------------------------------------------------

def mentions(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, kind, value): distinct entities of each text, by its hash."""

    def run(batches):
        for batch in batches:
            keys, kinds, values = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for kind, value in sorted({e[2:] for e in find(text.as_py() or "")}):
                    keys.append(key)
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["key", "kind", "value"])

    return docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(
        run, "key bigint, kind string, value string")


def settled(entities: DataFrame, secret: bytes) -> DataFrame:
    """(kind, value, attempt, surrogate): distinct surrogates for distinct
    entities, none of them an entity that occurs.  Of those that meet, the one
    settled first, then the smallest value keeps its surrogate."""

    def run(batches):
        for batch in batches:
            kinds, values, tries = (batch.column(i).to_pylist() for i in range(3))
            names = [draw(secret, *x) for x in zip(kinds, values, tries)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], ["kind", "value", "attempt", "surrogate"])

    types = "kind string, value string, attempt int, surrogate string"
    real = entities.select("kind", F.col("value").alias("surrogate"))
    done = None
    open_ = entities.select("kind", "value").withColumn("attempt", F.lit(0))
    while True:  # ends, as the surrogates grow in number with each attempt
        drawn = open_.mapInArrow(run, types).withColumn("fresh", F.lit(1))
        if done is not None:
            drawn = done.withColumn("fresh", F.lit(0)).unionByName(drawn)
        keeps = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("fresh", "value")).alias("first"))
        judged = drawn.join(keeps, ["kind", "surrogate"]).join(
            real.withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left")
        judged = staged(judged.select(
            "kind", "value", "attempt", "surrogate",
            ((F.col("first.value") == F.col("value")) & F.col("taken").isNull()).alias("good")), "surrogates")
        done = judged.where("good").drop("good")
        open_ = judged.where("not good").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            return done


def surrogates(docs: DataFrame, secret: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``text`` with surrogates, ``n_entities`` (mentions),
    ``n_distinct`` and ``kinds`` (sorted, comma-joined)."""
    spark = docs.sparkSession
    on_workers(spark)
    found = staged(mentions(docs, text_col), "pii-mentions")
    entities = staged(found.select("kind", "value").distinct(), "pii-entities")
    again = settled(entities, secret).where("attempt > 0").select("kind", "value", "attempt")
    changes = found.join(again, ["kind", "value"]).distinct().groupBy("key").agg(
        F.collect_list(F.struct("kind", "value", "attempt")).alias("changes"))
    changes = staged(changes, "pii-changes")
    side = small_side(changes, changes.count(), 400)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        # mentions of one entity share their draw
        drawn = lru_cache(maxsize=50_000)(draw)
        for batch in batches:
            texts, counts, distinct, kinds = [], [], [], []
            for text, changed in zip(batch.column(1), batch.column(2)):
                text = text.as_py()
                attempts = {(c["kind"], c["value"]): c["attempt"] for c in changed.as_py() or ()}
                new, own = (None, []) if text is None else rewrite(text, secret, attempts, drawn)
                texts.append(new)
                counts.append(len(own))
                distinct.append(len(set(own)))
                kinds.append(",".join(sorted({k.split("-")[0] for k, _ in own})))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(distinct, pa.int64()), pa.array(kinds, pa.string())],
                ["id", "text", "n_entities", "n_distinct", "kinds"])

    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    out = keyed.join(side, "key", "left").select("id", "text", "changes").mapInArrow(
        run, f"id {kind}, text string, n_entities bigint, n_distinct bigint, kinds string")
    return out.withColumnRenamed("id", id_col)
