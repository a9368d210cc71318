"""Language identification by hierarchical discrimination.

Texts become hashed counts of 1- to 3-letter sequences (square root, unit
length). One-versus-one linear support vector machines first choose the
language family, then, within that family, the language. Every training row
teaches: the rows' letter counts are written once, each machine starts from a fit
of about ``SAMPLE`` rows of every label in a task of its own, and where a label has
more, all machines descend together on the whole loss (``refined``), each step
one pass over all rows. Each machine's margin is turned into a probability. A choice's score is its mean probability against the
others, the row's that of the family times that of the language within it.

A least score for each language, to tell texts in none of the languages
(``calibrated``), is taken from training rows that the machines judging them
have not seen: ``LENIENCE`` of what all but ``RARE`` of a language's rows reach.
It grows with the machines' certainty and not with the number of languages.

Defined cases: a null text or one without a letter is ``und`` with score 0, as
is every text if nothing could be learned; a single label (or family) needs no
machine; rows with a null label or text teach nothing; repeated rows repeat
their results; other columns are kept and those named ``lang_pred`` and
``score`` replaced; an empty table gives no rows. Whole texts are read, in
pieces of ``PIECE`` letters."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingspark.llm.common import bounded_batches, give_back, local_table, written

DIMENSIONS = 4096
#: Rows of each label, about, of the fits that the machines start from.
SAMPLE = 600
#: The slope below which a machine has settled (the start's 150 steps come about as near), the
#: passes at most, the steps that shape the next one, and the cells of a margin of 1.
SETTLED, PASSES, MEMORY, CELLS = 2.5e-4, 40, 8, 1024
PIECE = 1 << 18
#: Of a language with at least ``HELD_LEAST`` training rows one in ``HELD`` is held out to find its least score.
HELD, HELD_LEAST = 5, 10
LENIENCE, RARE = 0.65, 0.005
UND = "und"
#: Families of the commoner languages; any other label is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indo-aryan": ["hi", "bn", "mr", "ur", "pa", "gu", "ne"],
    "semitic": ["ar", "he", "mt"],
}


def family_of(label: str) -> str:
    return next((name for name, labels in FAMILIES.items() if label in labels), f"only {label}")


def letter_counts(text: str) -> np.ndarray:
    """Hashed letter-sequence counts. What is not a letter counts as one kind of gap."""
    counts = np.zeros(DIMENSIONS, dtype=np.int64)
    low = re.sub(r"[\W\d_]+", " ", text.lower())
    tail = np.zeros(2, dtype=np.uint64) + np.uint64(32)
    for at in range(0, len(low), PIECE):
        piece = np.frombuffer(low[at:at + PIECE].encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        c = np.concatenate([tail, piece])
        with np.errstate(over="ignore"):
            one = c[2:] * np.uint64(0x9E3779B97F4A7C15)
            two = one ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
            three = two ^ (c[:-2] * np.uint64(0x165667B19E3779F9) + np.uint64(2))
            codes = np.concatenate([one, two * np.uint64(0xD6E8FEB86659FD93), three * np.uint64(0xA0761D6478BD642F)])
        counts += np.bincount((codes >> np.uint64(52)).astype(np.int64), minlength=DIMENSIONS)
        tail = c[-2:]
    return counts


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of a text's letter counts."""
    root = np.sqrt(letter_counts(text), dtype=np.float32)
    return root / max(float(np.sqrt(root @ root)), 1e-12)


def packed_counts(text: str) -> tuple[bytes, bytes]:
    """Places and numbers of the letter counts above 0, a number in one byte where all fit."""
    counts = letter_counts(text)
    at = np.flatnonzero(counts)
    n = counts[at]
    return at.astype("<u2").tobytes(), n.astype("u1" if n.max(initial=0) < 256 else "<u4").tobytes()


def unpacked(places: Iterable[bytes], numbers: Iterable[bytes]) -> np.ndarray:
    """The texts' ``features``, one row each."""
    out = np.zeros((len(places), DIMENSIONS), np.float32)
    for row, at, n in zip(out, places, numbers):
        if at:
            row[np.frombuffer(at, "<u2")] = np.sqrt(np.frombuffer(n, f"<u{2 * len(n) // len(at)}"), dtype=np.float32)
            row /= max(float(np.sqrt(row @ row)), 1e-12)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float, float]:
    """A linear machine with squared hinge loss, both classes weighing the
    same, by accelerated gradients; and the two numbers that turn its margin
    into a probability (fitted by logistic regression)."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], dtype=np.float32)
    t = 1.0
    for _ in range(steps):
        short = np.maximum(0, 1 - y * (x @ ahead)) * y * weight
        new = ahead - (penalty * ahead - 2 * (x.T @ short)) / (2 + penalty)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + np.float32((t - 1) / t_new) * (new - w)
        w, t = new, t_new
    return w, *shaped((x @ w).astype(np.float64), y, weight)


def shaped(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The two numbers that turn a margin into a probability."""
    a, b = 4.0, 0.0
    goal = np.where(y > 0, 0.99, 0.01)
    for _ in range(25):  # Newton steps, kept from running off by the goals
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = (p - goal) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        hess = np.array([[h @ margin**2 + 1e-6, h @ margin], [h @ margin, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [d @ margin + 1e-6 * a, d.sum() + 1e-6 * b])
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
    return max(a, 0.1), b


def _direction(slope: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]], penalty: float) -> np.ndarray:
    """The next step, shaped by the last ones and how they changed the slope (L-BFGS)."""
    q, shares = slope.copy(), []
    for moved, change in reversed(steps):
        shares.append(moved @ q / (moved @ change))
        q -= shares[-1] * change
    q *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / (2 + penalty)
    for (moved, change), share in zip(steps, reversed(shares)):
        q += moved * (share - change @ q / (moved @ change))
    return -q


def refined(rows: DataFrame, uses: dict[str, list[tuple[str, float]]], fits: list[dict[str, tuple]],
            penalty: float = 1e-3) -> list[dict[str, tuple[np.ndarray, float, float]]]:
    """The machines of ``fits`` carried on to the least loss of ``fit_svm`` over all
    ``rows`` (lang, held, places, numbers). Held rows teach the last of ``fits`` alone.
    A pass adds up every machine's loss and slope in the tasks; only their sums, one
    a machine, reach the driver."""
    spark = rows.sparkSession
    slots = [(v, name) for v, own in enumerate(fits) for name in sorted(own)]
    number = {slot: i for i, slot in enumerate(slots)}
    found = {(r["lang"], r["held"]): r["count"] for r in rows.groupBy("lang", "held").count().collect()}
    sides, n = {}, np.zeros((len(slots), 2))
    for (label, held), count in found.items():
        own = [(number[v, name], y) for v in range(len(fits)) if v == len(fits) - 1 or not held
               for name, y in uses[label] if name in fits[v]]
        sides[label, held] = np.array([i for i, _ in own], int), np.array([y for _, y in own], np.float32)
        for i, y in own:
            n[i, int(y > 0)] += count
    scale = 0.5 / np.maximum(1, n)  # both classes weigh the same

    def parts(part: pd.DataFrame, weights: np.ndarray):
        """Rows of one kind at a time: their vectors, their machines, the sides they are on and the margins."""
        x = unpacked(part["places"], part["numbers"])
        for kind, at in part.groupby(["lang", "held"]).indices.items():
            machines, y = sides[kind]
            if len(machines):
                yield x[at], machines, y, x[at] @ weights[machines].T

    def slopes(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast(weights.astype(np.float32))

        def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loss, slope = np.zeros(len(slots)), np.zeros((len(slots), DIMENSIONS))
            for part in batches:
                for x, machines, y, margins in parts(part, shared.value):
                    short, weight = np.maximum(0, 1 - y * margins), scale[machines, (y > 0).astype(int)]
                    loss[machines] += weight * (short.astype(np.float64) ** 2).sum(0)
                    slope[machines] -= 2 * (weight * y)[:, None] * (short.T @ x)
            yield pd.DataFrame({"slot": range(len(slots)), "loss": loss, "slope": [s.tobytes() for s in slope]})
            give_back()

        def total(part: pd.DataFrame) -> pd.DataFrame:
            slope = sum(np.frombuffer(s) for s in part["slope"])
            return pd.DataFrame({"slot": part["slot"].iloc[:1], "loss": [part["loss"].sum()], "slope": [slope.tobytes()]})

        schema = "slot long, loss double, slope binary"
        loss, slope = np.zeros(len(slots)), np.zeros(weights.shape)
        for r in rows.mapInPandas(added, schema).groupBy("slot").applyInPandas(total, schema).collect():
            loss[r["slot"]], slope[r["slot"]] = r["loss"], np.frombuffer(r["slope"])
        shared.unpersist()
        return loss + penalty / 2 * (weights ** 2).sum(1), slope + penalty * weights

    w = np.stack([fits[v][name][0] for v, name in slots]).astype(np.float64)
    loss, slope = slopes(w)
    steps: list[list] = [[] for _ in slots]
    way, length = np.stack([_direction(g, [], penalty) for g in slope]), np.ones(len(slots))
    moving = np.linalg.norm(slope, axis=1) > SETTLED
    for _ in range(PASSES):
        if not moving.any():
            break
        tried = w + (moving * length)[:, None] * way
        new_loss, new_slope = slopes(tried)
        for i in np.flatnonzero(moving):
            if new_loss[i] > loss[i] + 1e-4 * length[i] * (slope[i] @ way[i]):
                length[i] /= 2
                continue
            step = tried[i] - w[i], new_slope[i] - slope[i]
            if step[0] @ step[1] > 1e-12:
                steps[i] = [*steps[i], step][-MEMORY:]
            w[i], loss[i], slope[i], length[i] = tried[i], new_loss[i], new_slope[i], 1.0
            way[i], moving[i] = _direction(slope[i], steps[i], penalty), np.linalg.norm(slope[i]) > SETTLED

    shared = spark.sparkContext.broadcast(w.astype(np.float32))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for _, machines, y, margins in parts(part, shared.value):
                for i, side, own in zip(machines.tolist(), y.tolist(), margins.T):
                    cell, count = np.unique(np.rint(own * CELLS).astype(int), return_counts=True)
                    yield pd.DataFrame({"slot": i, "side": side, "cell": cell, "count": count})
        give_back()

    def shape(part: pd.DataFrame) -> pd.DataFrame:
        y = part["side"].to_numpy()
        weight = part["count"].to_numpy() * scale[part["slot"].iloc[0], (y > 0).astype(int)]
        a, b = shaped(part["cell"].to_numpy() / CELLS, y, weight)
        return pd.DataFrame({"slot": part["slot"].iloc[:1], "a": [a], "b": [b]})

    spreads = rows.mapInPandas(spread, "slot long, side double, cell long, count long").groupBy(
        "slot", "side", "cell").agg(F.sum("count").alias("count"))
    out: list[dict] = [{} for _ in fits]
    for r in spreads.groupBy("slot").applyInPandas(shape, "slot long, a double, b double").collect():
        v, name = slots[r["slot"]]
        out[v][name] = w[r["slot"]].astype(np.float32), r["a"], r["b"]
    return out


def is_training_row(id_col: str) -> Column:
    """Rows whose crc32 of the id as text leaves a rest other than 2 by 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 != 2, F.lit(True))


class Machines:
    """The fitted hierarchy: small, one weight vector per pair of labels."""

    def __init__(self, labels: list[str], fitted: dict[str, tuple[np.ndarray, float, float]],
                 least: dict[str, float] | None = None):
        #: Least scores by label; a label too rare to hold rows out has the lowest of the others.
        self.least = least or {}
        self.families: dict[str, list[str]] = {}
        for label in sorted(labels):
            self.families.setdefault(family_of(label), []).append(label)
        self.names = sorted(fitted)
        self.weights = np.stack([fitted[n][0] for n in self.names]) if fitted else np.zeros((0, DIMENSIONS), "f4")
        self.shape = np.array([fitted[n][1:] for n in self.names]).reshape(-1, 2)

    @staticmethod
    def pairs(labels: list[str]) -> list[tuple[str, str, str]]:
        """``(name, positive, negative)`` of all machines that labels need."""
        families = sorted({family_of(x) for x in labels})
        out = [(f"family {a} | {b}", a, b) for a, b in combinations(families, 2)]
        for family in families:
            own = sorted(x for x in labels if family_of(x) == family)
            out += [(f"label {a} | {b}", a, b) for a, b in combinations(own, 2)]
        return out

    def _best(self, kind: str, choices: list[str], odds: dict[str, float]) -> tuple[str, float]:
        """The choice with the highest mean probability against the others."""
        if len(choices) == 1:
            return choices[0], 1.0
        total = dict.fromkeys(choices, 0.0)
        for a, b in combinations(choices, 2):
            p = odds[f"{kind} {a} | {b}"]
            total[a] += p
            total[b] += 1 - p
        best = max(choices, key=lambda c: (total[c], c))
        return best, total[best] / (len(choices) - 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.families or not re.search(r"[^\W\d_]", text):
            return UND, 0.0
        return self.judge(features(text))

    def judge(self, x: np.ndarray) -> tuple[str, float]:
        margins = self.weights @ x
        p = 1 / (1 + np.exp(-np.clip(self.shape[:, 0] * margins + self.shape[:, 1], -30, 30)))
        odds = dict(zip(self.names, p.tolist()))
        family, sure = self._best("family", sorted(self.families), odds)
        label, within = self._best("label", self.families[family], odds)
        return label, sure * within


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE, calibrated: bool = False) -> Machines:
    """Fits the hierarchy on all training rows of ``docs``, starting from fits of
    about ``sample`` rows a label, and if ``calibrated`` finds the least score of
    each label. Label counts, least scores and the machines' weights and slopes
    reach the driver, no rows."""
    bounded_batches(docs.sparkSession)
    rows = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                        F.col(f"`{lang_col}`").alias("lang"))
            .where(is_training_row("id") & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    pairs = Machines.pairs(list(counts))
    if not pairs:
        return Machines(list(counts), {})
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, sample / n))])
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)

    @F.pandas_udf("places binary, numbers binary")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([packed_counts(t) for t in part], columns=["places", "numbers"])
        give_back()

    held = (F.pmod(F.xxhash64(F.lit("held out"), "id", "text"), F.lit(HELD)) == 0) & \
        F.col("lang").isin([label for label, n in counts.items() if min(n, sample) >= HELD_LEAST])
    table = written(rows.select("lang", held.alias("held"), drawn.alias("drawn"), counted("text").alias("x"))
                    .select("lang", "held", "drawn", "x.places", "x.numbers"), "language-rows")
    uses: dict[str, list] = {label: [] for label in counts}
    for name, a, b in pairs:
        for label in counts:
            side = label if name.startswith("label") else family_of(label)
            if side in (a, b):
                uses[label].append((name, 1.0 if side == a else -1.0))
    sides = local_table(docs.sparkSession, [
        (label, name, y) for label, of in uses.items() for name, y in of], "lang string, machine string, y double")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        w, a, b = fit_svm(unpacked(part["places"], part["numbers"]), part["y"].to_numpy(np.float32))
        return pd.DataFrame({"machine": [part["machine"].iloc[0]], "w": [w], "a": [a], "b": [b]})

    def started(some: DataFrame) -> dict[str, tuple[np.ndarray, float, float]]:
        fitted = (some.where("drawn").join(F.broadcast(sides), "lang").select("machine", "y", "places", "numbers")
                  .groupBy("machine").applyInPandas(fit, "machine string, w array<float>, a double, b double").collect())
        return {r["machine"]: (np.array(r["w"], dtype=np.float32), r["a"], r["b"]) for r in fitted}

    fits = [started(some) for some in ([table.where("not held"), table] if calibrated else [table])]
    if max(counts.values()) > sample:
        fits = refined(table.drop("drawn"), uses, fits)
    if not calibrated:
        return Machines(list(counts), fits[0])
    shared = docs.sparkSession.sparkContext.broadcast(Machines(list(counts), fits[0]))

    @F.pandas_udf("label string, score double")
    def judged(places: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        model = shared.value
        return pd.DataFrame([model.judge(x) for x in unpacked(places, numbers)], columns=["label", "score"])

    found = table.where("held").select("lang", judged("places", "numbers").alias("found")).where("found.label = lang")
    least = found.groupBy("lang").agg(F.percentile("found.score", F.lit(RARE)).alias("score")).collect()
    return Machines(list(counts), fits[1], {r["lang"]: LENIENCE * r["score"] for r in least})


def certain(machines: Machines) -> Column:
    """Which rows of ``identify`` have a language, and at least its least score."""
    known = F.col("lang_pred") != UND
    if not machines.least:
        return known
    least = F.create_map(*[F.lit(x) for pair in sorted(machines.least.items()) for x in pair])
    return known & (F.col("score") >= F.coalesce(least[F.col("lang_pred")], F.lit(min(machines.least.values()))))


def identify(docs: DataFrame, machines: Machines, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machines)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for part in texts:
            yield pd.DataFrame([model.predict(t) for t in part], columns=["lang_pred", "score"])
        give_back()

    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return (docs.select(*[F.col(f"`{c}`") for c in others], predicted(F.col(f"`{text_col}`")).alias("found in text"))
            .select(*[F.col(f"`{c}`") for c in others], "`found in text`.lang_pred", "`found in text`.score"))


def predictions(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Trains on the training rows and predicts every row."""
    rows = docs.select(id_col, "text", "lang")
    found = identify(rows.select(id_col, "text"), train(rows, id_col))
    return found.select(id_col, (~is_training_row(id_col)).alias("held_out"), "lang_pred", "score")
