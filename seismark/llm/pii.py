"""Personal data: exact base patterns, and a boosted-tree choice among high-recall candidates. DataFrame functions only.

A kind's matches and the text between them come from one regular expression, and places from running sums of their
lengths. Base spans are checked (digits, ranges, Luhn) and always stay. Generators then propose further, overlapping spans
(numbers, long tokens, addresses, account numbers) of any length, with format and context features; gradient-boosted trees,
grown from Spark's sums over all weakly labelled candidates and turned into a column expression, score them, and those above a
threshold that keeps a held-out fold's precision are added. All candidates that can be added, which overlap no base span, are
learned from or set the threshold.

Weak labels: a candidate that follows a word such as token or password with = or :, or an account number with a right check
sum, is positive. The trees see neither: they learn what such strings look like, so that those without the word are found.

Defined cases: a null or empty text has no spans; very long texts are searched whole; spans of different kinds may overlap,
and of equal places both stay; in a redacted text overlapping spans become one mark; repeated rows get equal results; an
empty table gives an empty result; all columns are kept, but columns named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

# The base patterns, with possessive repeats and run starts, which match the same spans in linear time.
_LOCAL, _NAME = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_NAME}++(?:\.{_NAME}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Candidates: possessive repeats keep them linear, whatever their length.
_GROUP = r"[0-9]++(?![A-Za-z])"
CANDIDATES = {
    "number": rf"(?<![A-Za-z0-9.])[+(]?(?=[0-9](?:[\x20().\x2d/]?[0-9]){{6}}){_GROUP}(?:[\x20().\x2d/]{_GROUP})*+(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{20,}+",
    "address": r"(?<![^\s])[^\s@]++@[^\s@]{3,}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])",
}
KINDS = (*BASE, *CANDIDATES)
CONTEXT = 24
#: Trees, their depth and step; the precision that the threshold keeps, below 1 also because secrets without a word before them
#: count as false.
TREES, DEPTH, STEP, PRECISION = 30, 3, 0.3, 0.95
#: Cuts of all features, which are whole numbers: each to 48, then by a quarter of their size; what is above the last is one bin.
EDGES = np.concatenate([np.arange(49.0), np.floor(48 * 1.25 ** np.arange(1, 46))])
#: Parts of 1 that gradients are rounded to; parts of 1 that thresholds stand on, and how many of them to either side.
SCALE, STEPS, MOST = 1 << 20, 256, 1 << 12
FEATURES = ("length", "digits", "letters", "capitals", "marks", "groups", "vowels", "turns", "is_number", "is_token", "is_address", "is_account", "hexadecimal", "quoted", "alone", "contact")
_SECRET = r"(?i)(token|secret|passw(or)?d|api[_\s-]?key)\s*[=:]\s*[\"']?$"


def _running(lengths: Column) -> Column:
    """Running sums of an array of ints, in blocks of about its root, so that no prefix is summed afresh."""
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths))).cast("int"))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, b: a + b)
    counted = F.struct(lengths.alias("each"), size.alias("size"))
    blocked = F.transform(F.array(counted), lambda s: F.struct(s["each"].alias("each"), s["size"].alias("size"), F.transform(F.sequence(F.lit(0), s["size"]), lambda j: total(F.slice(s["each"], j * s["size"] + 1, s["size"]))).alias("blocks")))
    based = F.transform(blocked, lambda s: F.struct(s["each"].alias("each"), s["size"].alias("size"), F.transform(F.sequence(F.lit(0), s["size"]), lambda j: total(F.slice(s["blocks"], 1, j))).alias("before")))
    return F.get(
        F.transform(
            based,
            lambda s: F.transform(s["each"], lambda _x, i: F.get(s["before"], F.floor(i / s["size"]).cast("int")) + total(F.slice(s["each"], F.floor(i / s["size"]).cast("int") * s["size"] + 1, F.pmod(i, s["size"]) + 1))),
        ),
        0,
    )


def matches(text: Column, kind: str, pattern: str, wanted: Column | None = None) -> Column:
    """Array of (kind, start, end, value, before, after) of a pattern's matches; places in code points, the end exclusive."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>")
    both = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between")))
    placed = F.transform(
        both,
        lambda s: F.struct(
            s["found"].alias("found"),
            s["between"].alias("between"),
            F.transform(s["found"], lambda _x, i: F.length(F.get(s["between"], i)) + F.when(i > 0, F.length(F.get(s["found"], i - 1))).otherwise(0)).alias("steps"),
        ),
    )
    summed = F.transform(placed, lambda s: F.struct(s["found"].alias("found"), s["between"].alias("between"), _running(s["steps"]).alias("starts")))
    spans = F.transform(
        summed,
        lambda s: F.transform(
            s["found"],
            lambda x, i: F.struct(
                F.lit(kind).alias("kind"),
                F.get(s["starts"], i).alias("start"),
                (F.get(s["starts"], i) + F.length(x)).alias("end"),
                x.alias("value"),
                F.right(F.get(s["between"], i), F.lit(CONTEXT)).alias("before"),
                F.left(F.get(s["between"], i + 1), F.lit(1)).alias("after"),
            ),
        ),
    )
    found = text.rlike(pattern) if wanted is None else wanted & text.rlike(pattern)
    return F.when(found, F.get(spans, 0)).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    reversed_digits = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(F.filter(reversed_digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def account_check(value: Column) -> Column:
    """Whether an account number's letters and digits, the first four moved to the end and A read as 10, are 1 modulo 97."""
    plain = F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))
    moved = F.concat(F.substring(plain, 5, 1 << 20), F.left(plain, F.lit(4)))
    coded = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(coded, F.lit(0), lambda a, c: (a * F.when(c > 9, 100).otherwise(10) + c) % 97) == 1


def base_spans(text: Column, kind: str) -> Column:
    found = matches(text, kind, BASE[kind], F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else None)
    if kind == "ip":
        return F.filter(found, lambda x: x["value"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    if kind == "card":
        return F.filter(found, lambda x: luhn(x["value"]))
    if kind == "phone":
        return F.filter(found, lambda x: F.length(_digits(x["value"])).between(8, 15))
    return found


def _features(x: Column, base: Column) -> Column:
    """A candidate with its features as doubles, whether it overlaps a base span, and its weak label."""
    value, count = x["value"], lambda keep: F.length(F.regexp_replace(x["value"], f"[^{keep}]", ""))
    overlaps = F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    flags = {
        "length": F.length(value),
        "digits": count("0-9"),
        "letters": count("A-Za-z"),
        "capitals": count("A-Z"),
        "marks": F.length(value) - count("A-Za-z0-9"),
        "groups": F.size(F.split(value, "[^A-Za-z0-9]+")),
        "is_number": (x["kind"] == "number").cast("int"),
        "is_token": (x["kind"] == "token").cast("int"),
        "vowels": count("aeiouAEIOU"),
        "turns": F.size(F.split(value, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")),
        "is_address": (x["kind"] == "address").cast("int"),
        "is_account": (x["kind"] == "account").cast("int"),
        "hexadecimal": value.rlike("^[0-9a-f]+$").cast("int"),
        "quoted": x["after"].isin('"', "'").cast("int"),
        "alone": x["before"].rlike("(^|\n)\\s*$").cast("int"),
        "contact": x["before"].rlike("(?i)(tel|phone|fax|call|mail|contact|mobile)[.:]?\\s*$").cast("int"),
    }
    return F.struct(
        x["kind"].alias("kind"),
        x["start"].alias("start"),
        x["end"].alias("end"),
        overlaps.alias("known"),
        (x["before"].rlike(_SECRET) | ((x["kind"] == "account") & account_check(value))).alias("label"),
        F.array(*[flags[f].cast("double") for f in FEATURES]).alias("features"),
    )


def _topped(features: Column) -> Column:
    """Features raised to the next of EDGES, which takes them to the same side of every cut; infinite above the last."""
    edges = F.array(*[F.lit(float(e)) for e in EDGES])
    return F.transform(features, lambda x: F.coalesce(F.when(x.isin(*range(49)), x), F.get(F.filter(edges, lambda e: e >= x), 0), F.lit(float("inf"))))


def empty_sums() -> np.ndarray:
    return np.zeros((2 ** (DEPTH + 1) - 1, len(FEATURES), len(EDGES) + 1, 3), np.int64)


class Trees:
    """Gradient-boosted regression trees for the logistic loss, grown level by level from sums over the bins of all rows.

    A tree is (features, cuts, values) of its nodes, the children of i at 2i + 1 and 2i + 2; leaves have the feature -1.
    """

    def __init__(self, x: np.ndarray | None = None, y: np.ndarray | None = None) -> None:
        self.start, self.trees = 0.0, []
        if y is not None and len(y):
            self.grow(int(y.sum()), len(y), lambda level: self._bin_sums(x, y, level))

    def grow(self, positive: int, rows: int, sums) -> None:
        """Adds all trees; ``sums(level)`` gives (node, feature, bin, rows or gradient or curvature) of the last tree's open nodes.

        Gradients and curvatures are whole numbers of 1/SCALE, so that no order of adding up changes them.
        """
        share = float(np.clip(positive / rows, 1e-3, 1 - 1e-3)) if rows else 1e-3
        self.start = float(np.log(share / (1 - share)))
        if not 0 < positive < rows:
            return
        for _ in range(TREES):
            size = 2 ** (DEPTH + 1) - 1
            self.trees.append((np.full(size, -1), np.zeros(size), np.zeros(size)))
            for level in range(DEPTH):
                if not self._split(sums(level)):
                    break
            if self.trees[-1][0][0] < 0:  # the next would see the same sums
                self.trees.pop()
                return

    def _bin_sums(self, x: np.ndarray, y: np.ndarray, level: int) -> np.ndarray:
        out = empty_sums()
        at = self._places(self.trees[-1], x)
        here = at >= 2**level - 1
        p = 1 / (1 + np.exp(-self.margins(x[here], len(self.trees) - 1)))
        each = np.stack([np.ones(len(p)), np.rint((y[here] - p) * SCALE), np.rint(p * (1 - p) * SCALE)], 1).astype(np.int64)
        for f in range(len(FEATURES)):
            np.add.at(out, (at[here], f, np.searchsorted(EDGES, x[here, f])), each)
        return out

    def _split(self, sums: np.ndarray) -> bool:
        """Splits the nodes with rows in ``sums`` where that gains; whether any was."""
        features, cuts, values = self.trees[-1]
        leaf = lambda g, h: STEP * g / (h + 1)
        any_split = False
        for node in np.flatnonzero(sums[:, 0, :, 0].any(1)):
            low = np.cumsum(sums[node], 1)[:, :-1]
            n, g, h = sums[node, 0].sum(0) / (1, SCALE, SCALE)
            nl, gl, hl = low[:, :, 0], low[:, :, 1] / SCALE, low[:, :, 2] / SCALE
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            gain[(nl < 5) | (nl > n - 5)] = 0
            f, j = np.unravel_index(np.argmax(gain), gain.shape)
            values[node] = leaf(g, h)
            if gain[f, j] > 1e-6:
                features[node], cuts[node] = f, EDGES[j]
                values[2 * node + 1], values[2 * node + 2] = leaf(gl[f, j], hl[f, j]), leaf(g - gl[f, j], h - hl[f, j])
                any_split = True
        return any_split

    def _places(self, tree, x: np.ndarray) -> np.ndarray:
        features, cuts, _ = tree
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _level in range(DEPTH):
            f = features[at]
            at = np.where(f >= 0, 2 * at + 1 + (x[rows, f] > cuts[at]), at)
        return at

    def margins(self, x: np.ndarray, first: int | None = None) -> np.ndarray:
        """Margins by all trees, or by the ``first`` ones."""
        total = np.full(len(x), self.start)
        for tree in self.trees[:first]:
            total = total + tree[2][self._places(tree, x)]
        return total

    def walked(self, tree: int, features: Column, leaf) -> Column:
        """``leaf(node)`` of the leaf that features reach in a tree."""
        names, cuts, _ = self.trees[tree]

        def of(node: int) -> Column:
            if names[node] < 0:
                return F.lit(leaf(node))
            return F.when(F.get(features, int(names[node])) <= float(cuts[node]), of(2 * node + 1)).otherwise(of(2 * node + 2))

        return of(0)

    def added(self, tree: int, features: Column) -> Column:
        return self.walked(tree, features, lambda node: float(self.trees[tree][2][node]))

    def column(self, features: Column) -> Column:
        total = F.lit(self.start)
        for tree in range(len(self.trees)):
            total = total + self.added(tree, features)
        return total


def fit(candidates: DataFrame) -> tuple[Trees, float]:
    """Trees and the margin from which candidates are chosen; rows: (order, label, features). Four fifths fit, one sets the threshold.

    All rows count. Spark counts those of equal bins, fold and label; each level of a tree is one sum over these cells, of which
    the driver gets a number per node, feature and bin. The threshold is the least step that keeps the precision.
    """
    cells = candidates.select(_topped(F.col("features")).alias("features"), F.coalesce("label", F.lit(False)).cast("int").alias("label"), (F.pmod("order", F.lit(5)) == 0).alias("fold"))
    cells = written(cells.groupBy("features", "label", "fold").agg(F.count("*").alias("n")))
    fitted, held = cells.where("NOT fold").drop("fold"), cells.where("fold")
    trees, features = Trees(), F.col("features")

    def sums(level: int) -> np.ndarray:
        nonlocal fitted
        if level == 0:
            before = F.lit(trees.start) if len(trees.trees) == 1 else F.col("margin") + trees.added(-2, features)
            fitted = written(fitted.withColumn("margin", before))
        p = 1 / (1 + F.exp(-F.col("margin")))
        rows = fitted.select("*", trees.walked(-1, features, int).alias("node"), p.alias("p")).where(F.col("node") >= 2**level - 1)
        rows = rows.select("node", "n", F.rint((F.col("label") - F.col("p")) * SCALE).cast("long").alias("g"), F.rint(F.col("p") * (1 - F.col("p")) * SCALE).cast("long").alias("h"), F.posexplode("features").alias("f", "x"))
        found = rows.groupBy("node", "f", "x").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("g")).alias("g"), F.sum(F.col("n") * F.col("h")).alias("h")).toArrow()
        out = empty_sums()
        node, f, x = (found[c].to_numpy() for c in ("node", "f", "x"))
        out[node, f, np.searchsorted(EDGES, x)] = np.stack([found[c].to_numpy() for c in "ngh"], 1)
        return out

    counted = fitted.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("positive")).first()
    trees.grow(counted.positive or 0, counted.n or 0, sums)
    if not trees.trees:
        return trees, np.inf
    step = F.least(F.greatest(F.floor(trees.column(features) * STEPS), F.lit(-MOST)), F.lit(MOST))
    steps = held.groupBy(step.alias("step")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("positive")).orderBy(F.desc("step")).toArrow()
    step, n, positive = (steps[c].to_numpy() for c in ("step", "n", "positive"))
    good = np.flatnonzero(np.cumsum(positive) >= PRECISION * np.cumsum(n))
    return trees, max(float(step[good[-1]]) / STEPS, 0.0) if len(good) else np.inf


def find_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with base (checked spans of the four kinds in order) and added (chosen candidates): arrays of (kind, start, end)."""
    kept = [c for c in docs.columns if c not in ("base", "added", "_proposed")]
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(*kept, docs["text"].alias("_text"))
    each = {kind: base_spans(text, kind) for kind in BASE}
    rows = rows.select("*", F.concat(*each.values()).alias("_base"))
    rows = rows.select("*", F.concat(*[matches(text, kind, pattern) for kind, pattern in CANDIDATES.items()]).alias("_found"))
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    rows = written(rows.select(*kept, F.transform("_base", plain).alias("base"), F.transform("_found", lambda x: _features(x, F.col("_base"))).alias("_proposed")))
    order = F.xxhash64("_c.start", "_c.features", "base")
    trees, least = fit(rows.select("base", F.explode("_proposed").alias("_c")).where("NOT _c.known").select(order.alias("order"), "_c.label", "_c.features"))
    if np.isinf(least):
        chosen = F.filter("_proposed", lambda _x: F.lit(False))
    else:
        chosen = F.filter("_proposed", lambda x: ~x["known"] & (trees.column(x["features"]) >= least))
    return rows.withColumn("added", F.transform(chosen, plain)).drop("_proposed")


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, by kind as listed, then by start."""
    of = lambda kind: F.array_sort(F.filter(spans, lambda x: x["kind"] == kind))
    listed = [of(kind) for kind in KINDS]
    return F.array_join(F.transform(F.concat(*listed), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of text replaced by its kind in brackets, overlapping spans by one."""
    found = find_spans(docs)
    by_start = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    merged = F.aggregate(
        F.col("_spans"),
        F.array().cast("array<struct<start:int,end:int,kind:string>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, F.greatest(F.size(done), F.lit(1)))["end"] >= x["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"), F.element_at(done, -1)["kind"].alias("kind")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    found = found.withColumn("_spans", by_start).withColumn("_spans", merged)
    before = lambda i: F.when(i > 0, F.get(F.col("_spans"), i - 1)["end"]).otherwise(0)
    pieces = F.transform("_spans", lambda x, i: F.concat(F.substring(F.col("text"), before(i) + 1, x["start"] - before(i)), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    last = F.element_at("_spans", -1)["end"]
    clean = F.when(F.size("_spans") > 0, F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), last + 1, F.length("text")))).otherwise(F.col("text"))
    return found.withColumn("text", clean).select(*docs.columns)
