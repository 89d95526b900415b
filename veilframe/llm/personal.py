"""Personal data in texts by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

Four fixed patterns are always reported. Beyond them, looser patterns propose spans, and six labelers
(formats, checks, lists, words around) vote for, against, or not at all. How far each can be trusted is
estimated from the votes of all documents alone; the spans labelled so train a classifier that also sees
the words around a span and its shape, and that has the last word.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, prepare, slices

# The patterns of the task, in the forms that read a long run of characters once.
LOCAL, DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
#: What the method adds: e-mail addresses spelled out, phone numbers without a plus sign, numbers of accounts and persons, names.
ADDED = ("mail", "call", "number", "name")
KINDS = (*BASE, *ADDED)
LABELERS = ("format", "check", "list", "cue", "counter", "edges")

# What the labelers look for.
AT, DOT = r"(?:@|\(at\)|\[at\]|\{at\}|\x20at\x20)", r"(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)"
MAIL = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}\x20?{AT}\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?{DOT}\x20?[A-Za-z0-9-]{{1,63}})+"
CALL = r"(?<![0-9A-Za-z.+/_-])\(?[0-9]{1,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,8}\)?){1,6}(?![0-9A-Za-z_])"
NUMBER = r"(?<![0-9A-Za-z])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?|[0-9](?:[\x20-]?[0-9]){8,18})(?![0-9A-Za-z])"
NAME = r"(?<![\w'-])[A-ZÀ-Þ][a-zß-ÿ]{1,20}(?:-[A-ZÀ-Þ][a-zß-ÿ]{1,20})?(?:\x20[A-Z]\.)?(?:\x20[A-ZÀ-Þ][a-zß-ÿ]{1,20}){1,2}(?![\w'-])"
DATE = r"(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{2}|[0-9]{4}))(?:\x20.*)?"
LOCAL_PHONE = r"\(?[2-9][0-9]{2}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}|\(?0[0-9]{1,4}\)?[\x20/-][0-9\x20/-]{5,12}"
DOMAINS = frozenset("com org net edu gov info io co uk de fr es it nl eu ch at be se no dk pl pt br mx us ca au in jp".split())
FILES = frozenset("png jpg jpeg gif js css py java html txt md json xml so exe".split())
GIVEN = frozenset(
    "Alexander Alice Amanda Andrea Andrew Anna Anne Anthony Antonio Barbara Benjamin Brian Carlos Carmen Caroline Catherine "
    "Charles Charlotte Christian Christine Christopher Claire Claudia Daniel David Deborah Diego Dorothy Edward Elena "
    "Elizabeth Emily Emma Eric Felix Fernando Francisco Frank George Gerald Hannah Hans Heinrich Helen Henry Isabel Isabelle "
    "Jacob James Javier Jean Jennifer Jessica Joan Johann John Jonas Jose José Joseph Juan Julia Julie Karen Karl Katharina "
    "Kevin Laura Lauren Lena Linda Lisa Louis Lucas Lukas Luis Manuel Marco Margaret Maria María Marie Mark Martin Mary "
    "Matthew Maximilian Michael Michelle Miguel Nancy Nathalie Nicolas Olivia Pablo Patricia Patrick Paul Pedro Peter "
    "Philippe Pierre Rachel Rebecca Richard Robert Ronald Rosa Samuel Sandra Sarah Sebastian Sofia Sophie Stefan Stephanie "
    "Stephen Steven Susan Teresa Theresa Thomas Ursula Victor Victoria Virginia William Wolfgang".split()
)
TITLES = frozenset("mr mrs ms dr prof herr frau señor señora sr sra monsieur madame mme".split())
PLACES = frozenset(
    "street avenue road university college airport river inc ltd gmbh prize hall park award station church bridge museum "
    "january february march april may june july august september october november december monday tuesday wednesday thursday "
    "friday saturday sunday island county school hospital".split()
)
CUES = {
    "mail": frozenset("email e-mail mail mailto contact write reach kontakt correo courriel address".split()),
    "call": frozenset("tel phone call fax mobile cell whatsapp telephone telefon telefono teléfono téléphone mobil dial number".split()),
    "number": frozenset("card visa mastercard amex account iban ssn social konto tarjeta carte cuenta passport tax credit debit bank".split()),
    "name": TITLES | frozenset("name author by signed sincerely regards contact patient customer client dear".split()),
}
COUNTERS = {
    "mail": frozenset("ssh scp git npm decorator".split()),
    "call": frozenset("order invoice ref isbn issn version fig figure nr id serial sku part lot score page pages chapter dates table".split()),
    "number": frozenset("order invoice ref isbn issn ean barcode tracking version serial sku lot hash checksum timestamp id part".split()),
    "name": frozenset("saint st the mount lake port fort".split()),
}

FEATURES = 1 << 12
CANDIDATE = "struct<type:int,start:int,end:int,votes:string,features:array<int>>"
SPAN = "struct<kind:string,start:int,end:int>"


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


class Labelers:
    """Finds spans in one text: the fixed ones, and others with the votes and features of each."""

    def __init__(self, given: frozenset[str]):
        self.given = given
        self.ip, self.card, self.phone, self.domain = (re.compile(p) for p in (IP, CARD, PHONE, DOMAIN))
        self.patterns = {t: re.compile(p) for t, p in (("mail", MAIL), ("call", CALL), ("number", NUMBER), ("name", NAME))}
        self.date, self.local = re.compile(DATE), re.compile(LOCAL_PHONE)
        self.word, self.digits = re.compile(r"[\w'-]+"), re.compile("[^0-9]+")

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the fixed patterns; each kind is looked for by itself."""
        found, end, at = [], 0, text.find("@")
        local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
        while at >= 0:
            start = at
            while start > end and text[start - 1] in local:
                start -= 1
            domain = self.domain.match(text, at + 1) if start < at else None
            if domain:
                found.append((start, 0, domain.end()))
                end = domain.end()
            at = text.find("@", at + 1)
        found += [(m.start(), 1, m.end()) for m in self.ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in self.card.finditer(text):
            if m.end() - m.start() >= 12:
                digits = self.digits.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in self.phone.finditer(text) if 9 <= len(self.digits.sub("", m[0])) <= 15]
        return sorted(found)

    def proposed(self, text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
        """(type, start, end) of what may be personal: the fixed spans among it, so that labelers meet sure cases too."""
        as_type = ("mail", None, "number", "call")
        for start, kind, end in base:
            if as_type[kind]:
                yield as_type[kind], start, end
        low = text.lower()
        for kind, pattern in self.patterns.items():
            if kind == "mail" and not (" dot " in low or "at)" in low or "at]" in low or "at}" in low):
                continue
            for m in pattern.finditer(text):
                if kind == "mail" and "@" in m[0] or kind == "call" and not 7 <= len(self.digits.sub("", m[0])) <= 15:
                    continue
                if kind == "name" and not self.named(text, m):
                    continue
                yield kind, m.start(), m.end()

    def named(self, text: str, m: re.Match) -> bool:
        """Whether there is any reason to take capitalised words for a name: a listed first name, or a title before."""
        first = m[0].split()[0].split("-")[0]
        return first in self.given or bool(TITLES & set(self.before(text, m.start())[-1:])) or first.lower() in TITLES

    def before(self, text: str, start: int) -> list[str]:
        return [w.lower() for w in self.word.findall(text[max(0, start - 40) : start])[-4:]]

    def votes(self, kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
        """One vote of each labeler: 1 for personal data, -1 against, 0 for no opinion."""
        span, before = text[start:end], self.before(text, start)
        digits = self.digits.sub("", span)
        after = [w.lower() for w in self.word.findall(text[end : end + 30])[:1]]
        if kind == "mail":
            tail = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
            form = 1 if "@" in span else 0
            check = 1 if len(tail) >= 2 and tail.isalpha() else -1
            listed = 1 if tail in DOMAINS else -1 if tail in FILES else 0
        elif kind == "call":
            form = 1 if span[0] == "+" or self.local.fullmatch(span) else 0
            check = -1 if self.date.fullmatch(span) else 1 if 9 <= len(digits) <= 15 else 0
            listed = 1 if span[0] == "+" and digits[0] != "0" else -1 if re.fullmatch(r"[0-9.]+", span) and span.count(".") < 2 else 0
        elif kind == "number":
            iban, ssn = span[0].isalpha(), re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", span)
            form = 1 if iban or ssn or 13 <= len(digits) <= 19 else 0
            if iban:
                check = 1 if mod97(span.replace(" ", "")) else -1
            elif ssn:
                check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
            else:
                check = 1 if len(digits) >= 12 and luhn(digits) else -1
            listed = 1 if re.match(r"4|5[1-5]|3[47]|6011|35", digits) and len(digits) in (15, 16) else 0
        else:
            words = span.split()
            place = bool(PLACES & {w.lower() for w in [*words, *after]})
            form = 1 if 2 <= len(words) <= 3 and not place else -1
            check = -1 if place else 1
            listed = 1 if words[0].split("-")[0] in self.given and not place else 0
        cue = 1 if CUES[kind] & set(before) or kind == "name" and span.split()[0].lower() in TITLES else 0
        counter = -1 if COUNTERS[kind] & set(before[-2:]) else 0
        around = text[start - 1 : start] + text[end : end + 1]
        edges = -1 if re.search(r"[\w/=@#&_]", around) else 1 if not around.strip(" \t\n.,;:!?()\"'") else 0
        return form, check, listed, cue, counter, edges

    def features(self, kind: str, text: str, start: int, end: int, votes: Sequence[int]) -> list[int]:
        """Numbers of hashed features: the votes, the shape, the length, the words around."""
        shape = re.sub(r"[0-9]+", "0", re.sub(r"[A-ZÀ-Þ]+", "X", re.sub(r"[a-zß-ÿ]+", "x", text[start:end])))
        told = [f"v{i}{v}" for i, v in enumerate(votes)] + [f"s{shape[:24]}", f"l{(end - start) // 4}"]
        told += [f"b{i}{w}" for i, w in enumerate(self.before(text, start)[-2:])]
        told += [f"a{w.lower()}" for w in self.word.findall(text[end : end + 30])[:1]]
        return sorted({xxhash.xxh32_intdigest(f"{kind} {t}") % FEATURES for t in told})

    def candidates(self, text: str, base: list[tuple[int, int, int]]) -> list[dict]:
        out = []
        for kind, start, end in self.proposed(text, base):
            votes = self.votes(kind, text, start, end)
            spelled = "".join("-0+"[v + 1] for v in votes)
            out.append({"type": ADDED.index(kind), "start": start, "end": end, "votes": spelled, "features": self.features(kind, text, start, end, votes)})
        return out


def reliabilities(counts: dict[str, int], rounds: int = 60, strength: float = 4.0) -> dict[str, float]:
    """How likely each pattern of votes marks personal data, by expectation-maximisation over how often each occurs.

    The model: a span is personal or not, and each labeler votes by itself, with unknown shares of its
    three votes in either case. Priors of a few spans (``strength``) say that labelers are better than
    chance, which names the two classes and carries types with hardly any spans.
    """
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    vote = np.array([["-0+".index(c) for c in p] for p in patterns]).reshape(len(patterns), len(LABELERS))
    one_hot = np.eye(3)[vote]
    prior = strength * np.array([[4.0, 4.0, 1.0], [1.0, 4.0, 4.0]]) / 9  # against, none, for; not personal, personal
    posterior = np.clip(0.5 + 0.2 * (vote - 1).sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        classes = np.stack([1 - posterior, posterior]) * weight
        shares = np.einsum("cp,plv->clv", classes, one_hot) + prior[:, None, :]
        shares = np.log(shares / shares.sum(axis=2, keepdims=True))
        personal = np.log((classes.sum(axis=1) + strength / 2) / (weight.sum() + strength))
        both = personal[:, None] + np.einsum("clv,plv->cp", shares, one_hot)
        posterior = 1 / (1 + np.exp(np.clip(both[0] - both[1], -35, 35)))
    return dict(zip(patterns, posterior.tolist(), strict=True))


def fit_classifier(features: list[np.ndarray], targets: np.ndarray, passes: int = 200, rate: float = 0.5, l2: float = 1e-3) -> np.ndarray:
    """Weights (the bias last) of a logistic regression on indicator features with probabilities as labels."""
    many = np.array([len(f) for f in features])
    flat, row = np.concatenate(features), np.repeat(np.arange(len(features)), many)
    w, grown = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-8)
    for _ in range(passes):
        z = np.bincount(row, w[flat], len(features)) + w[-1]
        miss = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - targets) / len(features)
        g = np.append(np.bincount(flat, miss[row], FEATURES), miss.sum()) + l2 * w
        grown += g * g
        w -= rate * g / np.sqrt(grown)
    return w


def find_personal(
    df: DataFrame,
    text_col: str = "text",
    carry: Sequence[str] | None = None,
    given_names: Iterable[str] = GIVEN,
    sample_spans: int = 20_000,
    least: float = 0.5,
) -> DataFrame:
    """The columns ``carry`` of ``df`` (all by default) with ``personal``: spans (kind, start, end) by start, then kind.

    Starts and ends are code points, ends exclusive. Kinds of ``BASE`` are the fixed patterns, of which
    none is left out; those of ``ADDED`` are what the classifier finds at ``least`` likely to be personal
    and that overlaps no fixed span and no likelier one. Votes are counted over all documents; the
    classifier is fitted on some ``sample_spans`` different spans, picked by a hash.

    A null or empty text has no spans. Repeated rows are each reported. An empty table gives no rows. A
    column named ``personal`` in ``df`` is replaced; other columns are kept.
    """
    spark = prepare(df.sparkSession)
    names = frozenset(given_names)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelers = Labelers(names)
        span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        candidate = pa.list_(pa.struct([("type", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))
        for part in slices(batches, "text"):
            fixed, others = [], []
            for text in part.column("text").to_pylist():
                base = labelers.base(text) if text else []
                fixed.append([{"kind": k, "start": a, "end": b} for a, k, b in base])
                others.append(labelers.candidates(text, base) if text else [])
            yield pa.RecordBatch.from_arrays([part.column("rest"), pa.array(fixed, span), pa.array(others, candidate)], ["rest", "fixed", "candidates"])

    kept = [c for c in (df.columns if carry is None else carry) if c != "personal"]
    given = df.select(F.struct(*(df[c] for c in kept), F.lit(0).alias("_")).alias("rest"), df[text_col].cast("string").alias("text"))
    base_type = T.DataType.fromDDL("array<struct<kind:int,start:int,end:int>>")
    schema = T.StructType([given.schema["rest"], T.StructField("fixed", base_type), T.StructField("candidates", T.DataType.fromDDL(f"array<{CANDIDATE}>"))])
    labelled = cut(given.mapInArrow(label, schema))
    spans = labelled.select(F.explode("candidates").alias("c")).select("c.type", "c.votes", "c.features")
    # three votes of six labelers for four types: no more than 2916 rows at any size
    counts: dict[int, dict[str, int]] = {}
    for r in spans.groupBy("type", "votes").count().collect():
        counts.setdefault(r["type"], {})[r["votes"]] = r["count"]
    likely = {kind: reliabilities(found) for kind, found in counts.items()}
    different = cut(spans.distinct())
    share = min(1.0, sample_spans / max(1, different.count()))
    sample = different.where(F.pmod(F.xxhash64("type", "votes", "features"), F.lit(1 << 20)) < share * (1 << 20))

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        kind = int(rows["type"].iloc[0])
        rows = rows.sort_values("votes", kind="stable")
        targets = np.array([likely[kind][v] for v in rows["votes"]])
        weights = fit_classifier([np.asarray(f, np.int64) for f in rows["features"]], targets)
        return pd.DataFrame({"type": [kind], "weights": [weights.astype(np.float32).tobytes()]})

    models = sample.groupBy("type").applyInPandas(train, "type int, weights binary").collect()  # four at most
    shared = spark.sparkContext.broadcast({m["type"]: np.frombuffer(m["weights"], np.float32).astype(float) for m in models})

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for fixed, candidates in zip(batch.column("fixed").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                taken = [(s["start"], s["end"], s["kind"]) for s in fixed]
                scored = []
                for c in candidates:
                    w = shared.value.get(c["type"])
                    p = 0.0 if w is None else 1 / (1 + np.exp(-np.clip(w[c["features"]].sum() + w[-1], -35, 35)))
                    if p >= least:
                        scored.append((-p, c["start"], c["end"], len(BASE) + c["type"]))
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in sorted(clear(taken, scored), key=lambda s: (s[0], s[2], s[1]))])
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(out, made)], ["rest", "personal"])

    done = labelled.mapInArrow(decide, T.StructType([schema["rest"], T.StructField("personal", T.DataType.fromDDL(f"array<{SPAN}>"))]))
    return done.select(*[F.col("rest")[c].alias(c) for c in kept], "personal")


def clear(taken: list[tuple[int, int, int]], scored: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans taken, and of the scored ones, likeliest first, those that overlap none before them."""
    spans = list(taken)
    edges: list[tuple[int, int]] = []
    for a, b in sorted({(a, b) for a, b, _ in taken}):  # the fixed kinds may overlap each other
        if edges and a < edges[-1][1]:
            edges[-1] = (edges[-1][0], max(b, edges[-1][1]))
        else:
            edges.append((a, b))
    for _, a, b, kind in sorted(scored):
        at = bisect_left(edges, (a, b))
        if (at == len(edges) or edges[at][0] >= b) and (at == 0 or edges[at - 1][1] <= a):
            edges.insert(at, (a, b))
            spans.append((a, b, kind))
    return spans
