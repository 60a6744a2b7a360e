"""Operator 9: personal data. High-recall generators propose spans, boosted trees weigh their format and context, calibrated thresholds choose what to redact; four fixed patterns always stay."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boost
from .common import arrow_ready, as_bytes, map_batches, read

BASE = ("email", "ip", "card", "phone")
#: The kinds that the method adds, after the base kinds in every order.
ADDED = ("email_hidden", "phone_local", "national_id", "iban", "ip6", "account", "secret")
KINDS = BASE + ADDED
RANK = {k: i for i, k in enumerate(KINDS)}
#: Contexts to train in come from at most so many documents: of each a window of so many characters, from a hashed place anywhere in the whole text.
SAMPLE, WINDOW = 500, 400

LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Possessive forms of the patterns of the contract: a part that is followed by no dot isn't tried again from each of its digits, so long runs of digits take linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
Span = tuple[str, int, int]

GENERATORS = {
    "email_hidden": re.compile(r"[A-Za-z0-9_+-]{1,40}(?:\.[A-Za-z0-9_+-]{1,40}){0,4}\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?[A-Za-z0-9-]{1,40}(?:\s?(?:[\[({]\s?(?:dot|DOT|\.)\s?[\])}]|\.)\s?[A-Za-z0-9-]{2,40}){1,4}"),
    "phone_local": re.compile(r"(?<![\w+.-])(?:00[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-]{1,2}[0-9]{2,5}){1,4}(?![\w-])"),
    "national_id": re.compile(r"(?<![\w-])(?:[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}|[0-9]{8}-?[A-Z]|[A-CEGHJ-PR-TW-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D])(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)"),
    "ip6": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "account": re.compile(r"(?<![\w.-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\w-]|\.[0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/-]{16,}={0,2}(?![A-Za-z0-9_+/-])"),
}
CUES = {
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "telefon", "anruf", "móvil", "teléfono", "téléphone", "appel"),
    "mail": ("mail", "contact", "write", "kontakt", "contacto", "courriel", "correo"),
    "id": ("ssn", "social", "security", "passport", "identity", "dni", "ausweis", "sécurité"),
    "bank": ("iban", "account", "bank", "transfer", "konto", "cuenta", "compte", "virement"),
    "secret": ("token", "key", "apikey", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "passwort", "contraseña", "clave", "mdp", "jeton"),
    "net": ("ip", "host", "server", "address", "login", "ipv6"),
    "other": ("version", "isbn", "page", "order", "invoice", "section", "chapter", "price", "year", "part", "no.", "nr", "figure", "score", "pages", "range", "article", "ratio", "date", "law", "commit", "sha", "checksum", "digest", "etag", "revision", "build", "uuid", "path", "file", "ticket", "id"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the four fixed patterns, leftmost and non-overlapping within a kind; a match that fails its test is dropped and not tried again."""
    found: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text, start - 1):
            start -= 1
        end = DOMAIN.match(text, at + 1) if start < at else None
        if end:
            found.append(("email", start, end.end()))
            last = end.end()
        else:
            last = at + 1
        at = text.find("@", at + 1)
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 14 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return found


def proposals(text: str) -> list[Span]:
    """What the generators propose: many spans, overlapping and mostly wrong."""
    found = []
    if DIGIT.search(text):
        for kind in ("phone_local", "national_id", "iban", "ip6", "account"):
            found += [(kind, *m.span()) for m in GENERATORS[kind].finditer(text)]
        found += [("secret", *m.span()) for m in GENERATORS["secret"].finditer(text) if DIGIT.search(m.group()) and re.search("[A-Za-z]", m.group())]
    if "[" in text or "(" in text or "{" in text:
        found += [("email_hidden", *m.span()) for m in GENERATORS["email_hidden"].finditer(text)]
    return found


#: The letters that check a Spanish identity number by its remainder modulo 23, and beginnings of well-known access keys.
CHECK_LETTERS, KEY_STARTS = "TRWAGMYFPDXBNJZSQVHLCKE", ("sk-", "sk_", "pk_", "AKIA", "ghp_", "gho_", "xoxb-", "xoxp-", "glpat-", "AIza", "eyJ")


def _entropy(s: str) -> float:
    share = np.array(list(Counter(s).values())) / max(1, len(s))
    return float(-(share * np.log2(share)).sum()) if s else 0.0


def span_features(text: str, span: Span) -> list[float]:
    """Format of the span (length, digits, groups, check sums, entropy) and context (neighbouring characters, cue words within 40 characters before and 20 after)."""
    kind, start, end = span
    s = text[start:end]
    digits = re.sub(r"[^0-9]", "", s)
    groups = re.findall(r"[0-9]+", s)
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    near = set(re.findall(r"[^\W\d_]+\.?", before + " " + after))
    bare = re.sub(r"\s", "", s)
    mod97 = 0.0
    if kind == "iban" and bare.isalnum() and bare.isascii():
        mod97 = float(int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1)
    seps = set(re.sub(r"[0-9A-Za-z]", "", s))
    letters = sum(c.isalpha() for c in s)
    runs = re.findall(r"[A-Za-z]+", s)
    lead = before.rstrip().rstrip("\"'`").rstrip()[-1:]
    return [
        *(float(kind == k) for k in ADDED), len(s), len(digits), len(groups), max(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        len(seps), float("(" in s), float("." in seps), float("/" in seps), mod97, float(luhn(digits)) if digits else 0.0, float(s.startswith("0")), float(len(set(digits)) <= 2),
        float(groups[:1] in (["000"], ["666"]) or (bool(groups) and groups[0][0] == "9")), float(bool(groups) and len(groups[0]) == 4 and groups[0][:2] in ("19", "20")),
        *(float(any(n == c or n.rstrip(".") == c for n in near for c in cues)) for cues in CUES.values()),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after), float(before.rstrip()[-1:] == ":"),
        _entropy(s), letters, float(all(c in "0123456789abcdefABCDEF" for c in s)), float(s != s.lower() and s != s.upper()), max(map(len, runs), default=0), len(re.findall(r"[-_/]", s)), float(s.startswith(KEY_STARTS)),
        float(lead == "="), float(before[-1:] in ("'", '"', "`") and before != ""), float(len(digits) == 8 and s[-1:].isalpha() and CHECK_LETTERS[int(digits) % 23] == s[-1]),
    ]


def _number(rng: np.random.Generator, n: int) -> str:
    return str(rng.integers(1, 10)) + "".join(map(str, rng.integers(0, 10, n - 1)))


def _iban(rng: np.random.Generator) -> str:
    country, body = ("DE", "FR", "ES", "GB")[rng.integers(4)], _number(rng, 18)
    check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
    whole = f"{country}{check:02d}{body}"
    return " ".join(whole[k : k + 4] for k in range(0, len(whole), 4)) if rng.random() < 0.5 else whole


def examples(contexts: list[str], rounds: int = 400, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labelled spans made by rule, set into contexts from the corpus: real forms of each kind (1), and version, order, page and date numbers, prices and broken check sums that look like them (0)."""
    rng = np.random.default_rng(seed)
    contexts = [c for c in contexts if len(c) > 80] or ["of the one and for in that was with " * 6]
    n = lambda k: _number(rng, k)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    chars = lambda kinds, k: "".join(kinds[j] for j in rng.integers(0, len(kinds), k))

    def identity() -> str:
        number = n(8)
        return number + CHECK_LETTERS[int(number) % 23]

    national = (lambda: f"{rng.integers(100, 600)}-{n(2)}-{n(4)}", identity, lambda: f"{chars('ABCEGHJKLMNPRSTWXYZ', 2)} {n(2)} {n(2)} {n(2)} {chars('ABCD', 1)}")
    good = {
        "phone_local": lambda: (f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"0{n(2)} {n(2)} {n(2)} {n(2)} {n(2)}", f"0{n(3)}/{n(5)}")[rng.integers(4)],
        "national_id": lambda: national[rng.integers(3)](),
        "account": lambda: (n(16), " ".join(n(4) for _ in range(4)), "-".join(n(4) for _ in range(4)))[rng.integers(3)],
        "secret": lambda: (chars(hexes, 40), chars(hexes, 32), chars(hexes, 64), chars(alnum, int(rng.integers(20, 49))), KEY_STARTS[rng.integers(len(KEY_STARTS) - 1)] + chars(alnum, int(rng.integers(20, 41))))[rng.integers(5)],
        "iban": lambda: _iban(rng),
        "ip6": lambda: ":".join(f"{x:x}" for x in rng.integers(1, 65536, 8)),
        "email_hidden": lambda: f"{word()}{(' [at] ', '(at)', ' (at) ')[rng.integers(3)]}{word()}{(' [dot] ', '.', '(dot)')[rng.integers(3)]}com",
    }
    bad = (
        lambda: f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", lambda: f"{n(2)}.{n(2)}.{rng.integers(1900, 2030)}", lambda: f"{n(3)}-{n(3)}", lambda: f"{n(2)}/{n(2)}",
        lambda: f"{n(3)} {n(3)}", lambda: f"{n(2)}.{n(2)}", lambda: f"978-{n(2)}-{n(4)}-{n(3)}", lambda: f"{n(4)} {n(4)}", lambda: f"9{n(2)}-{n(2)}-{n(4)}", lambda: f"GB{n(2)} {n(4)} {n(4)} {n(4)}",
        lambda: f"{n(8)}{chars('ABCDEFGHIJ', 1)}", lambda: f"978{n(10)}", lambda: f"20{n(12)}", lambda: n(12), lambda: f"{word()}-{n(1)}-{word()}-{word()}-{n(2)}", lambda: f"{word()}/{word()}_{n(4)}/{word()}", lambda: f"{word()}_{word()}_{word()}{n(2)}",
        lambda: f"{n(2)} {n(2)} {n(2)} {n(2)}", lambda: f"{word()} (at) {word()}.{n(2)}", lambda: f"000-{n(2)}-{n(4)}",
    )
    cues = {"phone_local": "phone", "national_id": "id", "iban": "bank", "ip6": "net", "email_hidden": "mail", "account": "bank", "secret": "secret"}
    x, y, kinds = [], [], []

    def add(core: str, cue: str, label: int) -> None:
        c = contexts[rng.integers(len(contexts))]
        cut = int(rng.integers(40, len(c) - 30))
        named = (": ", " ", " = ", "=")[rng.integers(2 if cue not in CUES["secret"] else 4)] if cue else ""
        quote = ("", '"', "'")[rng.integers(3)] if cue in CUES["secret"] else ""
        spoken = (" number", " no.", " nr", "", "", "")[rng.integers(6)] if cue else ""
        head = c[:cut].rsplit(" ", 1)[0] + " " + cue + spoken + named + quote
        text = head + core + quote + (" ", " ", ", ", ". ")[rng.integers(4)] + c[cut : cut + 60].lstrip()
        for s in proposals(text):
            if s[1] < len(head) + len(core) and s[2] > len(head):
                x.append(span_features(text, s)), y.append(int(label and s[1] == len(head) and s[2] == len(head) + len(core))), kinds.append(s[0])

    for _ in range(rounds):
        for kind, make in good.items():
            clued = kind in ("phone_local", "national_id", "secret", "account") or rng.random() < 0.5
            add(make(), CUES[cues[kind]][rng.integers(len(CUES[cues[kind]]))] if clued else "", 1)
        for make in bad:
            add(make(), CUES["other"][rng.integers(len(CUES["other"]))] if rng.random() < 0.5 else "", 0)
        add(good["phone_local"](), CUES["other"][rng.integers(len(CUES["other"]))], 0)  # a bare grouped number proves nothing
        for _ in range(2):
            add(good["account"](), "", 0)  # nor does a long one that no cue word is near
        for kind in ("national_id", "account", "secret"):  # nor does a number of goods or the mark of a revision
            add(good[kind](), CUES["other"][rng.integers(len(CUES["other"]))], 0)
    return np.array(x), np.array(y), np.array(kinds)


@dataclass
class Model:
    forest: boost.Forest
    cuts: dict[str, float]


def fit(contexts: list[str], precision: float = 0.97) -> Model:
    """Trees on three quarters of the examples; on the rest, the lowest threshold of each kind whose precision is at least `precision`. A kind that has none adds nothing."""
    x, y, kinds = examples(contexts)
    check = np.arange(len(y)) % 4 == 3
    forest = boost.fit(x[~check], y[~check], trees=50, depth=4)
    p = forest.predict(x[check])
    cuts = {}
    for kind in ADDED:
        own = kinds[check] == kind
        at = np.unique(p[own & (y[check] == 1)])
        cuts[kind] = next((float(c) for c in at if c >= 0.5 and y[check][own & (p >= c)].mean() >= precision), 2.0)
    return Model(forest, cuts)


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """Of the proposals that reach their kind's threshold, the surest first, those that overlap neither a base span nor a surer one."""
    found = proposals(text)
    if not found:
        return []
    p = model.forest.predict(np.array([span_features(text, s) for s in found]))
    chosen = sorted((-float(p[k]), s[1], -s[2], RANK[s[0]], s) for k, s in enumerate(found) if p[k] >= model.cuts[s[0]])
    taken, out = sorted(base, key=lambda s: s[1]), []
    for *_, s in chosen:
        if all(s[2] <= t[1] or s[1] >= t[2] for t in taken):
            taken.append(s)
            out.append(s)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], RANK[x[0]], x[2])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each maximal run of overlapping spans replaced by the kind of its first span in brackets."""
    out, last = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], RANK[x[0]], x[2])):
        if start >= last:
            out += [text[last:start], f"[{kind}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def train(docs: DataFrame, limit: int = SAMPLE) -> Model:
    """A model with contexts from at most `limit` documents of the lowest id hashes: `WINDOW` characters from a hashed place of the whole text of each. The labelled spans are made by rule."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1
    rows = docs.select("doc_id", F.substring("text", start, F.lit(WINDOW)).alias("part")).join(F.broadcast(ids), "doc_id").toArrow()  # at most limit ids
    return fit([h for _, h in sorted((i, h or "") for i, h in zip(rows["doc_id"].to_pylist(), rows["part"].to_pylist(), strict=True))])


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the four base counts, base_sha256 and all spans of each row, as kind:start:end in code points. A null or empty text has none; very long texts are searched whole; of added spans that overlap and are equally sure the first and longest stays;
    repeated rows each give a row; a null id stays null; further columns are ignored."""
    arrow_ready(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, sums, spans = [], [], []
        for value in batch["text"]:
            text = value.as_py().decode("utf-8", "replace")
            base = base_spans(text)
            n = Counter(k for k, _, _ in base)
            counts.append([n[k] for k in BASE])
            sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(base + added_spans(text, base, model)))
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(BASE))]
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), *columns, pa.array(sums, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return map_batches(docs.select("doc_id", as_bytes().alias("text")), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with personal data in text replaced by its kind; a null text stays null, an empty one empty; very long ones are searched whole; repeated rows stay repeated; all other columns, of whatever names, as they are;
    an empty table gives no rows."""
    arrow_ready(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        return None if text is None else redact(text, (base := base_spans(text)) + added_spans(text, base, model))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        texts = [None if t is None else t.decode("utf-8", "replace") for t in batch.column(at).cast(pa.binary()).to_pylist()]
        new = pa.array([clean(t) for t in texts], batch.schema.field(at).type)
        return pa.record_batch([new if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return map_batches(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return find(docs, train(docs))
