"""Score formulas and training maths as Columns. A formula is a driver object that compiles to one expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import boolean, finite

DIAGNOSTIC = {"score_vlm": 0.35, "score_ocr": 0.25, "cer_quality": 0.20, "entropy_quality": 0.10, "exact_text_match": 0.10}
SOURCES = {"cer_quality": "cer", "entropy_quality": "entropy"}


def unit(value: Column) -> Column:
    x = finite(value)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))  # greatest and least skip nulls


@dataclass(frozen=True)
class Formula:
    """Weighted geometric mean (or product) of the components that are there."""

    weights: dict[str, float] = field(default_factory=lambda: dict(DIAGNOSTIC))
    thresholds: dict[str, float] = field(default_factory=dict)
    entropy_scale: float = 1.0
    product: bool = False
    require_all: bool = False

    def component(self, name: str) -> Column:
        if name == "cer_quality":
            return 1.0 - unit(F.col("cer"))
        if name == "entropy_quality":
            h = finite(F.col("entropy"))
            return F.when(h >= 0, F.exp(-self.entropy_scale * h))
        if name == "exact_text_match":
            return F.coalesce(boolean(F.col(name)).cast("double"), unit(F.col(name)))
        return unit(F.col(name))

    def used(self) -> dict[str, Column]:
        return {n: self.component(n) for n, w in self.weights.items() if w > 0}

    def missing(self) -> Column:
        """Names of evidence that is not there, in the order of the weights."""
        return F.array_compact(F.array(*[F.when(c.isNull(), F.lit(SOURCES.get(n, n))) for n, c in self.used().items()]))

    def complete(self) -> Column:
        return F.size(self.missing()) == 0

    def score(self) -> Column:
        """A component of zero makes the score zero; its logarithm is never taken."""
        parts = self.used()
        zero, weight, logs = F.lit(False), F.lit(0.0), F.lit(0.0)
        for name, c in parts.items():
            w = float(self.weights[name])
            zero = zero | F.coalesce(c <= 0, F.lit(False))
            weight = weight + F.when(c.isNotNull(), w).otherwise(0.0)
            logs = logs + F.when(c > 0, w * F.ln(F.when(c > 0, c))).otherwise(0.0)
        value = F.exp(logs / (F.lit(1.0) if self.product else F.when(weight > 0, weight)))
        none = (F.size(self.missing()) > 0) if self.require_all else F.lit(False)
        return F.when(none | zero | (weight <= 0), 0.0).otherwise(value)

    def flags(self) -> dict[str, Column]:
        """Whether each threshold (name_min or name_max) is met; without evidence it is not."""
        out = {}
        for name, limit in self.thresholds.items():
            part, _, side = name.rpartition("_")
            if side not in ("min", "max") or not part:
                out[name] = F.lit(False)
                continue
            c = self.component(part) if part in ("cer_quality", "entropy_quality", "exact_text_match") else finite(F.col(part))
            out[name] = F.coalesce(c >= limit if side == "min" else c <= limit, F.lit(False))
        return out


def vlm_ocr() -> Formula:
    return Formula({"score_vlm": 1.0, "score_ocr": 1.0}, product=True, require_all=True)


def formula_for(mode: str) -> Formula:
    if mode not in ("product", "diagnostic"):
        raise ValueError(f"no formula is named {mode!r}")
    return vlm_ocr() if mode == "product" else Formula()


def ocr_reward(cer: Column, entropy: Column, scale: float = 1.0) -> Column:
    quality = 1.0 - F.least(F.lit(1.0), cer)
    return F.coalesce(quality * F.exp(-scale * finite(entropy)), quality)


def yes_ratio(yes: Column, no: Column) -> Column:
    return yes / (yes + no + 1e-8)


def yes_ratio_plain(yes: Column, no: Column) -> Column:
    return F.coalesce(F.try_divide(yes, yes + no), F.lit(0.0))


def sigma(t: Column, shift: float) -> Column:
    s = t / 1000.0
    return shift * s / (1.0 + (shift - 1.0) * s)


def beta(t: Column, strength: float, shift: float) -> Column:
    return strength * F.pow(1.0 - sigma(t, shift), F.lit(2.0)) / 2.0


def preference_logit(w_policy: Column, l_policy: Column, w_ref: Column, l_ref: Column, scale: Column) -> Column:
    return scale * ((w_ref - w_policy) - (l_ref - l_policy))


def preference_loss(logit: Column) -> Column:
    """-log sigmoid, in the form that does not overflow."""
    return F.when(logit >= 0, F.log1p(F.exp(-F.abs(logit)))).otherwise(F.log1p(F.exp(-F.abs(logit))) - logit)


def masked_blend(inside: Column, outside: Column, weight: float) -> Column:
    return weight * inside + (1.0 - weight) * outside


def plan_seed(seed: int, index: Column, versions: int, version: Column) -> Column:
    return F.lit(seed) + index * versions + version


def at_interval(step: Column, every: int) -> Column:
    return (step > 0) & (F.lit(every) > 0) & (F.pmod(step, F.lit(max(every, 1))) == 0)


def batch_size(per_device: Column, accumulation: Column, processes: Column) -> Column:
    return per_device * accumulation * processes


def learning_rate(step: Column, base: float, least: float, warmup: int, total: int, kind: str = "cosine") -> Column:
    """Linear warm-up, then constant or cosine down to the least rate."""
    floor = least / base if base > 0 else 0.0
    done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / F.lit(max(1, total - warmup))))
    after = F.lit(1.0) if kind == "constant" else floor + (1.0 - floor) * 0.5 * (1.0 + F.cos(F.pi() * done))
    return base * F.when(step < warmup, step / F.lit(max(1, warmup))).otherwise(after)


def sigma_grid(steps: int, low: float = 0.001, high: float = 1.0, shift: float = 3.0) -> Column:
    """Array of shifted sigmas from high to low, with a zero at the end."""
    line = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.lit(high) + (low - high) * k / F.lit(max(1, steps - 1)))
    return F.concat(F.transform(line, lambda s: shift * s / (1.0 + (shift - 1.0) * s)), F.array(F.lit(0.0)))


def frame_stats(frames: Column, blank: int = 0) -> dict[str, Column]:
    """Mean entropy, least top probability and share of uncertain frames, over frames whose best class is no blank.

    Rows that don't sum to about 1 are soft-maxed first. All null if every frame is blank.
    """

    def total(p: Column) -> Column:
        return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)

    def soft(p: Column) -> Column:
        e = F.transform(p, lambda x: F.exp(x - F.array_max(p)))
        return F.transform(e, lambda x: x / total(e))

    probs = F.transform(frames, lambda p: F.when(F.abs(total(p) - 1.0) <= 0.05, p).otherwise(soft(p)))
    live = F.filter(probs, lambda p: F.array_position(p, F.array_max(p)) != blank + 1)
    n = F.nullif(F.size(live), F.lit(0))
    entropy = F.transform(live, lambda p: -total(F.transform(p, lambda x: x * F.ln(F.greatest(x, F.lit(0.0)) + 1e-9))))
    top = F.transform(live, F.array_max)
    return {
        "entropy": total(entropy) / n,
        "min_p": F.array_min(top),
        "frac_unc": F.size(F.filter(top, lambda x: x < 0.5)) / n,
    }


def shannon(counts: Column) -> Column:
    """Entropy in nats of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.ln(F.when(x > 0, x) / total)).otherwise(0.0))


# fixed values: components that are computed from another field
COMPONENT_FIELDS = {"cer_quality": "cer", "entropy_quality": "entropy"}


def component_field(name: str) -> str:
    """The evidence field that a component is computed from."""
    return COMPONENT_FIELDS.get(name, name)


def threshold_rule(name: str) -> tuple[str, str] | None:
    """Component and side of a threshold's name; None for names of no side."""
    component, _, side = name.rpartition("_")
    return (component, side) if component and side in ("min", "max") else None


def result(formula: Formula) -> Column:
    """Score, completeness, missing evidence and threshold flags of a row as one struct."""
    flags = [x for name, met in formula.flags().items() for x in (F.lit(name), met)]
    return F.struct(
        formula.score().alias("score"),
        formula.complete().alias("complete"),
        formula.missing().alias("missing"),
        (F.create_map(*flags) if flags else F.create_map().cast("map<string,boolean>")).alias("flags"),
    )
