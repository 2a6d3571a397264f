"""Personal data and secrets by weak supervision.

Exact base rules find email, ip, card and phone spans, and wider patterns propose further candidates (local phone
numbers, national identity numbers, bank accounts, written-out email addresses, secrets, dates of birth, street addresses,
names behind a title).  Labelers vote for or against each candidate: its strict shape (regex), a check (sum, range or
variety of characters), a gazetteer, words before it (context), and its borders.  Counts of vote patterns over all
documents go through expectation-maximisation, which estimates for each kind the labelers' reliabilities without labels.
Its posteriors train a logistic span classifier with features of its own: hashed shape, ends and length of the span and
the words around it, beside the votes.  It is fitted on all candidates: each round sums the errors of every one of them by
feature, in integers, so the weights do not depend on how the rows are laid out.  Base spans always stay; the classifier
decides on the others.  Patterns are few (kinds x 3^labelers), whatever the corpus, and so are the classifier's weights.
Candidates are packed, 34 bytes each; up to ``LOCAL_SPANS`` of them are summed in the driver, beyond in a Spark job a round.

Edge cases: a null text is empty and has no span; offsets are code points, ends exclusive; a proposed span that overlaps
a base span or an earlier proposed one is left out; with no candidate at all the model accepts nothing; equal votes for
and against leave a candidate to its features; repeated rows give repeated rows.  Only ``doc_id`` and ``text`` are read, so
other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import releasing, staged

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("national_id", "birth_date", "bank_account", "spelled_email", "secret", "local_phone", "street_address", "person")
KINDS = BASE_KINDS + MORE_KINDS
ACCEPT = 0.8
EM_ROUNDS = 50
LABELERS = 5
#: Up to so many candidates train the classifier in the driver (9 MB); beyond, every round is a Spark job over all of them.
LOCAL_SPANS = 1 << 18
ROUNDS = 300
#: Hashed features of a candidate, and the weights that they share.
FEATURES, BUCKETS = 16, 1 << 14
#: Numbers of a candidate in a row's flat list: kind, start, end, vote pattern, features.
WIDTH = 4 + FEATURES
#: Candidates of a pack at most, and the units in which their errors are summed.
_PACK, _UNIT = 1 << 15, 1 << 24

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number starts at the first digit of its run: any later start fails as the first does, and trying is quadratic.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Way|Court|Square"
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Monsieur|Madame|Mme|Señora?|Sra?"
_MORE = {
    "local_phone": re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?(?![0-9-])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "bank_account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    # The part before the at-sign has at most 64 characters by the standard.
    "spelled_email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]+)+"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}"),
    "birth_date": re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![0-9/-])"),
    "street_address": re.compile(rf"\b[0-9]{{1,5}}[a-z]? (?:[A-Z][a-z]+ ){{1,3}}(?:{_STREETS})\b|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|platz|allee) [0-9]{{1,4}}[a-z]?\b|\b[0-9]{{1,4}},? (?:rue|avenue|boulevard|place) (?:(?:de|du|des|la|le) )*[A-ZÉ]\w+|\b(?:Calle|Avenida|Plaza) (?:(?:de|del|la|el) )*[A-ZÁÉÍÓÚÑ]\w+,? [0-9]{{1,4}}\b"),
    "person": re.compile(rf"\b(?:{_TITLES})\.? [A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'-]+(?: [A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'-]+){{0,2}}"),
}
_STRICT = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}"),
    "card": re.compile(r"[0-9]{16}|(?:[0-9]{4}[ -]){3}[0-9]{4}"),
    "phone": re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]+(?:[ .-][0-9]+)*"),
    "local_phone": re.compile(r"\([0-9]{2,5}\) ?[0-9]{3,4}[ -][0-9]{3,4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|0[0-9]{1,4}[ /-][0-9]{2,4}(?:[ -][0-9]{2,4}){1,2}"),
    "national_id": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "bank_account": re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"),
    "spelled_email": re.compile(r"\S+ ?[\[(]at[\])] ?\S+ ?[\[(]dot[\])] ?[A-Za-z]{2,24}"),
    "secret": re.compile(r"[0-9a-f]{24,128}|[0-9A-F]{24,128}|(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9].*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}"),
    "birth_date": re.compile(r"(?:19|20)[0-9]{2}-(?:0?[1-9]|1[0-2])-(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])([./-])(?:0?[1-9]|1[0-2])\1(?:19|20)[0-9]{2}|(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12][0-9]|3[01])/(?:19|20)[0-9]{2}"),
    "street_address": re.compile(r".*[A-ZÀ-Þ]\w{2,}.*"),
    "person": re.compile(r"\w+\.? [A-ZÀ-ÖØ-Þ]\S{2,}(?: [A-ZÀ-ÖØ-Þ]\S+)+"),
}
# Words before personal data of each kind, words before other things, top-level domains, calling codes,
# countries of bank accounts, beginnings of keys, given names.
_CUES = {
    "email": "email e-mail mail contact write kontakt correo courriel adresse address",
    "ip": "ip address host server login from adresse",
    "card": "card visa mastercard credit debit amex karte kreditkarte tarjeta carte pay",
    "phone": "phone tel telephone mobile cell call fax telefon handy teléfono móvil téléphone portable ring text",
    "national_id": "ssn social security passport identity id number insurance taxpayer ausweis dni pasaporte identité",
    "bank_account": "iban account bank konto kontonummer cuenta compte transfer bic",
    "secret": "token secret key api apikey password passwd pwd credential credentials auth bearer access passwort clave contraseña jeton",
    "birth_date": "born birth birthday dob birthdate geboren geburtsdatum geb nacido nacida nacimiento né née naissance",
    "street_address": "address live lives lived living at wohnt adresse anschrift dirección vive habite domicile street resident",
    "person": "dear signed contact name by from sincerely regards patient client lieber liebe estimado cher",
}
_CUES |= {"local_phone": _CUES["phone"], "spelled_email": _CUES["email"]}
_CUE_OF = {kind: re.compile(rf"(?<!\w)(?:{'|'.join(words.split())})(?!\w)", re.IGNORECASE) for kind, words in _CUES.items()}
_OTHER_CUES = re.compile(r"(?<!\w)(?:isbn|issn|doi|version|release|released|build|invoice|order|sku|part|model|page|pages|line|section|chapter|commit|revision|checksum|sha|hash|md5|digest|published|updated|score|figure|table|street of|file)(?!\w)", re.IGNORECASE)
_DOMAINS = set("com org net edu gov io de fr es uk eu it nl ch at be us ca info".split())
_CALLING = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 64 65 81 82 86 90 91".split())
_COUNTRIES = set("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MT NL NO PL PT RO SE SI SK".split())
_KEYS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_", "pk_", "rk_", "xox", "AIza", "ya29", "eyJ", "npm_", "hf_")
_GIVEN = set("james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen anna peter hans klaus ursula monika stefan sabine maria jose juan carmen antonio ana luis pedro lucia jean pierre michel marie claire sophie jacques nicolas isabelle jane paul laura emma daniel julia martin".split())
#: Characters before and behind a candidate in which words count as its context.
CONTEXT = 120
_WORDS = re.compile(r"\w+")

Span = tuple[int, int, int]  # kind number, start, end


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    odd = sum(int(d) for d in number[-1::-2])
    even = sum(sum(divmod(2 * int(d), 10)) for d in number[-2::-2])
    return (odd + even) % 10 == 0


def mod97(account: str) -> bool:
    moved = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: the run of allowed characters before an @ that a domain follows; linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield 0, start, found.end()
            free = found.end()
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[Span]:
    spans = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    spans += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        number = digits(m[0]) if 16 <= m.end() - m.start() <= 37 else ""
        if 16 <= len(number) <= 19 and luhn(number):
            spans.append((2, *m.span()))
    if "+" in text:
        spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return spans


def more_spans(text: str, base: list[Span]) -> list[Span]:
    """Proposed spans of the further kinds that overlap nothing before them."""
    found: list[Span] = []
    taken = None  # a byte for each character, 1 where a span is; made when first needed
    numbers = _DIGIT.search(text)
    for kind in MORE_KINDS:
        if not numbers and kind not in ("spelled_email", "person") or kind == "spelled_email" and not ("(at)" in text or "[at]" in text):
            continue
        for m in _MORE[kind].finditer(text):
            if taken is None:
                taken = bytearray(len(text))
                for _, s, e in base:
                    taken[s:e] = b"\1" * (e - s)
            start, end = m.span()
            if 1 not in taken[start:end]:
                found.append((KINDS.index(kind), start, end))
                taken[start:end] = b"\1" * (end - start)
    return found


def votes(text: str, span: Span) -> tuple[int, ...]:
    """Of each labeler: 1 for personal data, -1 against, 0 none."""
    k, start, end = span
    kind, value = KINDS[k], text[start:end]
    shape = 1 if _STRICT[kind].fullmatch(value) else -1
    check = gazetteer = 0
    if kind == "card":
        check = 1 if luhn(digits(value)) else -1
        gazetteer = 1 if value[0] in "3456" else 0
    elif kind == "bank_account":
        check = 1 if mod97(value) else -1
        gazetteer = 1 if value[:2] in _COUNTRIES else -1
    elif kind in ("email", "spelled_email"):
        gazetteer = 1 if re.split(r"\W+", value)[-1].lower() in _DOMAINS else 0
    elif kind == "phone":
        number = digits(value)
        gazetteer = 1 if any(number[:n] in _CALLING for n in (1, 2)) else 0
        check = 1 if 10 <= len(number) <= 13 else 0
    elif kind == "local_phone":
        check = 1 if 8 <= len(digits(value)) <= 12 else -1
    elif kind == "ip":
        first = int(value.partition(".")[0])
        gazetteer = -1 if first in (0, 127) or first > 239 else 1
    elif kind == "secret":
        variety = len(set(value)) / min(len(value), 16)
        check = 1 if variety >= 0.5 and len(re.findall("[0-9]", value)) >= 4 else -1
        gazetteer = 1 if value.startswith(_KEYS) else 0
    elif kind == "birth_date":
        year = int(re.search("[0-9]{4}", value)[0])
        check = 1 if 1900 <= year <= 2024 else -1
    elif kind == "person":
        gazetteer = 1 if {w.lower() for w in _WORDS.findall(value)} & _GIVEN else 0
    before = text[max(0, start - CONTEXT) : start]
    cue, other = list(_CUE_OF[kind].finditer(before)), list(_OTHER_CUES.finditer(before))
    # The nearer of both decides.
    context = 0 if not cue and not other else 1 if (cue[-1].end() if cue else -1) > (other[-1].end() if other else -1) else -1
    left, right = text[start - 1 : start], text[end : end + 1]
    if kind == "secret":
        border = 1 if left in ("'", '"', "=", ":", "`") or re.search(r"[=:]\s*$", before) else 0 if not (right.isalnum() or left.isalnum()) else -1
    else:
        border = -1 if any(c.isalnum() or c in "=/#$" for c in (left, right)) else 1
    return shape, check, gazetteer, context, border


def features(text: str, span: Span, vote: tuple[int, ...]) -> list[int]:
    """``FEATURES`` hashed features: votes, shape, ends and length of the span, words around it, each together with the kind."""
    kind, start, end = span
    value = text[start:end]
    shape = re.sub(r"([A-Za-z0-9 ])\1+", r"\1", re.sub("[a-zà-ÿ]", "a", re.sub("[A-ZÀ-Þ]", "A", re.sub("[0-9]", "0", value[:80]))))
    before = _WORDS.findall(text[max(0, start - CONTEXT) : start].lower())[-3:]
    after = _WORDS.findall(text[end : end + CONTEXT].lower())[:2]
    named = [f"v{j}{v}" for j, v in enumerate(vote)] + ["kind", f"s{shape[:24]}", f"n{min(len(value) // 3, 20)}", f"f{value[:2].lower()}", f"l{text[start - 1 : start]}", f"r{text[end : end + 1]}"]
    named += [f"b{k}{w}" for k, w in enumerate(reversed(before))] + [f"a{k}{w}" for k, w in enumerate(after)]
    named += ["kind"] * (FEATURES - len(named))
    return [zlib.crc32(f"{kind}|{x}".encode()) % BUCKETS for x in named[:FEATURES]]


def pattern_of(kind: int, vote: tuple[int, ...]) -> int:
    for v in vote:
        kind = kind * 3 + v + 1
    return kind


def votes_of(pattern: int) -> tuple[int, list[int]]:
    vote = []
    for _ in range(LABELERS):
        pattern, v = divmod(pattern, 3)
        vote.append(v - 1)
    return pattern, vote[::-1]


def _chance(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[x].sum(1), -30, 30)))


def _uses(pack: np.ndarray) -> np.ndarray:
    """How often each feature is seen."""
    return np.bincount(pack[:, 1:].ravel(), minlength=BUCKETS)


def _errors(pack: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Sums for each feature of how far its candidates are from the posterior ``wanted`` of their vote pattern, in units."""
    error = np.rint((wanted[pack[:, 0]] - _chance(weights, pack[:, 1:])) * _UNIT)
    return np.bincount(pack[:, 1:].ravel(), np.repeat(error, FEATURES), BUCKETS).astype(np.int64)  # exact: below 2^53


def _unpacked(pack: bytes) -> np.ndarray:
    return np.frombuffer(pack, np.uint16).reshape(-1, 1 + FEATURES)


def _summed(packs: list[np.ndarray] | DataFrame, of: Callable, *given: np.ndarray) -> np.ndarray:
    """Sum of ``of`` over all packs; of a table a row for each task reaches the driver."""
    if not isinstance(packs, DataFrame):
        return sum((of(pack, *given) for pack in packs), np.zeros(BUCKETS, np.int64))
    shared = packs.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for pack in batch.column(0):
                out += of(_unpacked(pack.as_py()), *shared.value)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["sums"])

    found = sum((np.frombuffer(row.sums, np.int64) for row in packs.mapInArrow(run, "sums binary").collect()), np.zeros(BUCKETS, np.int64))
    shared.destroy()
    return found


class Classifier:
    """Labelers' reliabilities of each kind by EM over counts of vote patterns, and a logistic classifier trained on its posteriors."""

    def __init__(self, counts: dict[int, int], packs: list[np.ndarray] | DataFrame):
        """``packs``: all candidates, a vote pattern and features each, as arrays or as a table of packs."""
        self.posterior, self.reliability = {}, {}
        for kind in range(len(KINDS)):
            patterns = sorted(p for p in counts if votes_of(p)[0] == kind)
            if patterns:
                posterior, self.reliability[kind] = self._expect(np.array([counts[p] for p in patterns], float), np.array([votes_of(p)[1] for p in patterns]))
                self.posterior |= dict(zip(patterns, posterior.tolist(), strict=True))
        self.weights = np.zeros(BUCKETS)
        momentum, seen = np.zeros(BUCKETS), _summed(packs, _uses) if counts else np.zeros(BUCKETS)
        scale = 1 / np.maximum(seen, 5.0)  # rare features learn no faster than those of five
        wanted = np.zeros(len(KINDS) * 3**LABELERS)
        wanted[list(self.posterior)] = list(self.posterior.values())
        for _ in range(ROUNDS if seen.any() else 0):
            momentum = 0.8 * momentum + 0.2 * (_summed(packs, _errors, self.weights, wanted) / _UNIT * scale - 0.002 * self.weights)
            self.weights += momentum

    @staticmethod
    def _expect(n: np.ndarray, vote: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each vote pattern, and P(vote | class) of each labeler for votes -1, 0, 1."""
        # At first, and as pseudo-counts throughout, every labeler is right more often than not.
        expected = np.array([[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]])
        table, prior, posterior, which = np.tile(expected[:, None, :], (1, LABELERS, 1)), 0.5, np.zeros(len(n)), np.arange(LABELERS)
        for _ in range(EM_ROUNDS):
            like = np.log(table[:, which[None, :], vote + 1]).sum(2) + np.log([[1 - prior], [prior]])
            posterior = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
            prior = float(np.clip((n * posterior).sum() / n.sum(), 0.05, 0.95))
            for y, weight in enumerate((n * (1 - posterior), n * posterior)):
                for j in range(LABELERS):
                    seen = np.bincount(vote[:, j] + 1, weight, 3) + 20 * expected[y]
                    table[y, j] = seen / seen.sum()
        return posterior, table

    def _chance(self, x: np.ndarray) -> np.ndarray:
        return _chance(self.weights, x)

    def accepts(self, found: list[int]) -> list[bool]:
        """For each candidate of a flat list whether it stays."""
        rows = np.array(found, np.int64).reshape(-1, WIDTH)
        return ((rows[:, 0] < len(BASE_KINDS)) | (self._chance(rows[:, 4:]) >= ACCEPT)).tolist()


def find_flat(text: str | None) -> list[int]:
    """All candidates of a text as one flat list, ``WIDTH`` numbers each."""
    if not text:
        return []
    out: list[int] = []
    base = base_spans(text)
    for span in base + more_spans(text, base):
        vote = votes(text, span)
        out += [*span, pattern_of(span[0], vote), *features(text, span, vote)]
    return out


def _find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find_flat(text) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "spans"])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, spans (flat: kind, start, end, vote pattern, features of each) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(releasing(_find_batches), "doc_id long, spans array<long>")


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()])], ["pack"])

    for batch in batches:
        rows = batch.column(0).flatten().to_numpy().reshape(-1, WIDTH)[:, 3:].astype(np.uint16)
        for at in range(0, len(rows), _PACK):
            held.append(rows[at : at + _PACK])
            size += len(held[-1])
            if size >= _PACK:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def _pattern_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(len(KINDS) * 3**LABELERS, np.int64)
    for batch in batches:
        for pack in batch.column(0):
            counts += np.bincount(_unpacked(pack.as_py())[:, 0], minlength=len(counts))
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["pattern", "n"])


def fit(found: DataFrame) -> Classifier:
    """Learn from all candidates in ``spans``: from the counts of their vote patterns, and from the features of each."""
    packs = staged(found.sparkSession, found.select("spans").mapInArrow(releasing(_pack_batches), "pack binary"), "packs")
    counted = packs.mapInArrow(_pattern_batches, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    counts = {row.pattern: row.n for row in counted.collect()}  # at most kinds x 3^labelers
    if sum(counts.values()) <= LOCAL_SPANS:
        return Classifier(counts, [np.concatenate([_unpacked(row.pack) for row in packs.collect()])] if counts else [])
    return Classifier(counts, packs)


def _digest_batches(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]
        for batch in batches:
            rows = []
            for flat in batch.column(1).to_pylist():
                spans = [tuple(flat[i : i + 3]) for i in range(0, len(flat), WIDTH)]
                kept = sorted(s for s, yes in zip(spans, model.accepts(flat) if flat else [], strict=True) if yes)
                names_of = [f"{KINDS[k]}:{s}:{e}" for k, s, e in kept]
                base = [x for x, (k, *_) in zip(names_of, kept, strict=True) if k < len(BASE_KINDS)]
                counts = [sum(k == b for k, *_ in kept) for b in range(len(BASE_KINDS))]
                rows.append((*counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(names_of)))
            kinds = [pa.int64()] * len(BASE_KINDS) + [pa.string()] * 2
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return run


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans of every document."""
    found = staged(docs.sparkSession, candidates(docs), "candidates")
    columns = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return found.mapInArrow(releasing(_digest_batches(fit(found))), f"doc_id long, {columns}, base_sha256 string, spans string")


def redact_text(text: str, found: list[int], model: Classifier) -> str:
    """Every base span and every accepted one becomes its kind in angle brackets; where spans overlap, one mark covers them."""
    spans = [tuple(found[i : i + 3]) for i in range(0, len(found), WIDTH)]
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for (k, s, e), yes in zip(spans, model.accepts(found), strict=True) if yes):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def finder():
    """A function of a text column: its candidates, as in ``candidates``."""

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(find_flat)

    return run


def redact(spark: SparkSession, model: Classifier):
    """A function of a text column and its candidates: the text without personal data; null stays null."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in batches:
            yield pd.Series([None if t is None else redact_text(t, list(f), shared.value) if len(f) else t for t, f in zip(texts, found, strict=True)], dtype=object)

    return run


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
