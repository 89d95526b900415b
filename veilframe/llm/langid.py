"""Language by family first, then by linear support vector machines between the family's languages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, part_of, prepare, slices, spread, sums, words_of

# Families of languages by their code; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "indic": "hi bn ur mr gu pa ne si",
    "iranian": "fa ku ps tg",
    "turkic": "tr az kk ky uz tk tt",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "malayic": "id ms jv su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Hashed features: byte n-grams of one to four bytes inside words with their edges.
FEATURES, ORDERS = 1 << 13, (1, 2, 3, 4)
#: Frequencies are multiplied by this.
SCALE = 20.0


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words (not empty), and how many each word has."""
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b" " + b" ".join(words.cast(pa.binary()).to_pylist()) + b"    ", np.uint8).astype(np.uint64)
    n = int(sizes.sum()) + len(sizes)  # each word with the blank before it
    word = np.repeat(np.arange(len(sizes)), sizes + 1)
    stop = np.repeat(np.cumsum(sizes + 1) + 1, sizes + 1)  # one blank after it
    found, owner, gram = [], [], np.zeros(n, np.uint64)
    for k in range(max(ORDERS)):
        gram = gram << np.uint64(8) | data[k : k + n]
        if k + 1 in ORDERS:
            inside = np.arange(n) + k < stop
            found.append((mixed(gram[inside] + np.uint64((k + 1) << 40)) % np.uint64(FEATURES)).astype(np.int32))
            owner.append(word[inside])
    owner, found = np.concatenate(owner), np.concatenate(found)
    return found[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def vectors(texts: pa.Array) -> np.ndarray:
    """Each text as the frequencies of its n-grams."""
    words = words_of(lowered(texts))
    out = np.zeros((len(texts), FEATURES), np.float32)
    if not len(words.codes):
        return out
    found, many = grams(words.distinct)
    for k, (a, b) in enumerate(zip(words.starts.tolist(), words.ends.tolist(), strict=True)):
        if a < b:
            out[k] = np.bincount(spread(found, many, words.codes[a:b]), minlength=FEATURES)
            out[k] *= SCALE / out[k].sum()
    return out


def support_vectors(x: np.ndarray, y: np.ndarray, rounds: int = 60, penalty: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine: averaged subgradient steps, classes weighed alike."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    weights, mean, turn, batch = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 0, 64
    random = np.random.default_rng(7)
    for _ in range(rounds):
        order = random.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            turn += 1
            step = 1 / (penalty * (turn + 1000))
            margin = y[rows] * (x[rows] @ weights[:-1] + weights[-1])
            pull = (share[rows] * y[rows] * (margin < 1)) / len(rows)
            weights *= 1 - step * penalty
            weights[:-1] += step * (pull @ x[rows])
            weights[-1] += step * pull.sum() * 0.1
            mean += (weights - mean) * (2 / (turn + 1))
    return mean


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """One machine per family against the rest, one per pair of languages of a family."""
    known = sorted(set(langs))
    family = {code: FAMILY_OF.get(code, code) for code in known}
    families = sorted(set(family.values()))
    of = np.array([families.index(family[c]) for c in langs])
    code = np.array([known.index(c) for c in langs])
    columns = [support_vectors(x, np.where(of == f, 1.0, -1.0)) if len(families) > 1 else np.zeros(x.shape[1] + 1) for f in range(len(families))]
    pairs = [(a, b) for a, b in combinations(range(len(known)), 2) if family[known[a]] == family[known[b]]]
    for a, b in pairs:
        mine = (code == a) | (code == b)
        columns.append(support_vectors(x[mine], np.where(code[mine] == a, 1.0, -1.0)))
    return {"langs": known, "families": [[i for i, c in enumerate(known) if family[c] == f] for f in families], "pairs": pairs, "weights": np.column_stack(columns)}


def train(rows: DataFrame, per_lang: int = 500) -> dict | None:
    """The machines, from (``text``, ``lang``); at most about ``per_lang`` rows of a language are used, picked by a hash.

    The sample, bounded by ``per_lang`` and the number of languages, is fitted in one task. None
    where there are no rows.
    """
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_lang / n))))
    picked = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, langs = [], []
        for part in slices(batches, "text"):
            x.append(vectors(part.column("text")))
            langs += part.column("lang").to_pylist()
        if langs:
            model = fit(np.concatenate(x), langs)
            row = [model["langs"]], [model["families"]], [model["pairs"]], [model["weights"].tobytes()]
            kinds = pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int32())), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["langs", "families", "pairs", "weights"])

    schema = "langs array<string>, families array<array<int>>, pairs array<array<int>>, weights binary"
    one = picked.select("text", "lang").repartition(1).sortWithinPartitions("lang", F.xxhash64("text")).mapInArrow(run, schema)
    model = one.first()
    return None if model is None else model.asDict()


def scores(texts: pa.Array, model: dict) -> tuple[list[int], np.ndarray]:
    """The chosen language of each text, and the product of the logistic margins that chose it."""
    weights = np.frombuffer(model["weights"]).reshape(FEATURES + 1, -1)
    words = words_of(lowered(texts))
    values = np.tile(weights[-1], (len(texts), 1))
    if len(words.codes):
        found, many = grams(words.distinct)
        size = np.maximum(sums(many[words.codes].astype(float), words.counts), 1)
        values += SCALE * sums(sums(weights[found], many)[words.codes], words.counts) / size[:, None]
    families, place = model["families"], {tuple(p): len(model["families"]) + i for i, p in enumerate(model["pairs"])}
    logistic = 1 / (1 + np.exp(-values))
    chosen = np.argmax(values[:, : len(families)], axis=1)
    langs, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for f, members in enumerate(families):
        mine = np.flatnonzero(chosen == f)
        if not len(mine):
            continue
        sure = logistic[mine, f] if len(families) > 1 else np.ones(len(mine))
        votes, trust = np.zeros((len(mine), len(members))), np.ones((len(mine), len(members)))
        for i, j in combinations(range(len(members)), 2):
            first = logistic[mine, place[members[i], members[j]]]
            votes[:, i] += first >= 0.5
            votes[:, j] += first < 0.5
            trust[:, i] = np.minimum(trust[:, i], first)
            trust[:, j] = np.minimum(trust[:, j], 1 - first)
        best = np.argmax(votes + 0.5 * trust, axis=1)
        langs[mine] = np.array(members)[best]
        score[mine] = sure * trust[np.arange(len(mine)), best]
    return langs.tolist(), score


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, per_lang: int = 500) -> DataFrame:
    """id, ``held_out``, ``lang_pred`` and ``score`` of every row of ``df``.

    The machines learn from the rows with a text and a language whose ``crc32(id) % folds`` is not 0;
    a prediction reads the text alone. A text that is null or has no letter is ``und`` with score 0,
    as is every text where there is nothing to learn from. A null id counts as the empty text in the
    fold; rows that repeat are predicted each for itself.
    """
    fold = part_of(df[id_col], folds)
    known = df.where((fold != 0) & df[lang_col].isNotNull() & df[text_col].isNotNull() & (df[lang_col] != "und"))
    model = train(known.select(df[text_col].alias("text"), df[lang_col].alias("lang")), per_lang)
    shared = prepare(df.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts, model = part.column("text"), shared.value
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            chosen, score = scores(texts, model) if model else ([0] * len(texts), np.zeros(len(texts)))
            names = [model["langs"][k] if has and model else "und" for k, has in zip(chosen, letters.tolist(), strict=True)]
            score = np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    given = df.select(df[id_col].alias("id"), (fold == 0).alias("held_out"), df[text_col].alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
