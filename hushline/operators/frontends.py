"""Registry of the two-channel front-ends as column expressions over long spectra."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushline.functions import complexes as c
from hushline.functions.complexes import Cx, cx
from hushline.functions.numeric import EPS, clip, d
from hushline.operators.ordered import quantiles
from hushline.operators.recurrence import Matrices, Recurrence, scan
from hushline.operators.spectra import BLOCK, PACKED, attach_bins, explode_bins


# Cells of a clip up to which its median is taken in one buffer.
AUDITED = 1_000_000


def near_bin() -> Cx:
    return cx("near")


def far_bin() -> Cx:
    return cx("far")



@dataclass(frozen=True)
class Settings:
    """Fixed values shared by all machines."""

    subtraction_strength: float = 0.5
    coherence_alpha: float = 0.95
    adaptive_step: float = 0.05
    eps: float = EPS
    block: int = BLOCK


@dataclass(frozen=True)
class FrontEnd:
    """Named views, the extra columns they need, and a gain diagnostic where there is one."""

    name: str
    views: dict[str, Callable[[Settings], Cx]]
    needs: tuple[str, ...] = ()
    diagnostics: dict[str, Callable[[Settings], Column]] = field(default_factory=dict)

    def primary(self, s: Settings) -> Cx:
        return next(iter(self.views.values()))(s)


def subtracted(s: Settings) -> Cx:
    near = c.magnitude(near_bin())
    kept = F.greatest(near - d(s.subtraction_strength) * c.magnitude(far_bin()), d(0.0))
    return c.scaled(near_bin(), kept / F.greatest(near, d(s.eps)))


def wiener_gain(s: Settings) -> Column:
    near, far = c.power(near_bin()), c.power(far_bin())
    return F.when(far == d(0.0), d(1.0)).otherwise(near / (near + far + d(s.eps)))


def static_gain(s: Settings) -> Column:
    return d(1.0) - F.col("static_coherence")


def adaptive_residual(s: Settings) -> Cx:
    """Error before the coefficient update: near minus the previous coefficient times far."""
    return c.minus(near_bin(), c.product(cx("before"), far_bin()))


_BOTH = {"near": lambda s: near_bin(), "far": lambda s: far_bin()}
REGISTRY: dict[str, FrontEnd] = {
    f.name: f
    for f in (
        FrontEnd("near", {"near": lambda s: near_bin()}),
        FrontEnd("far", {"far": lambda s: far_bin()}),
        FrontEnd("average", {"average": lambda s: c.scaled(c.plus(near_bin(), far_bin()), d(0.5))}),
        FrontEnd("difference", {"difference": lambda s: c.minus(near_bin(), far_bin())}),
        FrontEnd("early_concat", _BOTH),
        FrontEnd("spectral_subtraction", {"residual": subtracted}),
        FrontEnd("wiener", {"wiener": lambda s: c.scaled(near_bin(), wiener_gain(s))}, diagnostics={"gain": wiener_gain}),
        FrontEnd(
            "coherence_mask",
            {"coherence_mask": lambda s: c.scaled(near_bin(), static_gain(s))},
            ("static_coherence",),
            {"gain": static_gain, "static_coherence": lambda s: F.col("static_coherence")},
        ),
        FrontEnd(
            "adaptive_filter",
            {"adaptive_residual": adaptive_residual},
            ("adaptive",),
            {"adaptive_gain": lambda s: c.power(cx("after"))},
        ),
        FrontEnd("late_score_fusion", _BOTH),
    )
}


def frontend(name: str) -> FrontEnd:
    if name not in REGISTRY:
        raise ValueError(f"Unknown front-end: {name}")
    return REGISTRY[name]


def coherence_of(cross: Cx, near: Column, far: Column, eps: float) -> Column:
    return clip(c.power(cross) / (near * far + d(eps)), 0.0, 1.0)


def static_coherence(packed: DataFrame, s: Settings) -> DataFrame:
    """Clip-level magnitude-squared coherence per (clip_no, bin)."""
    cross = c.cross(near_bin(), far_bin())
    means = explode_bins(packed.select("clip_no", "block", *PACKED)).groupBy("clip_no", "bin").agg(
        F.max("block").alias("last_block"),
        F.avg(cross.re).alias("x_re"), F.avg(cross.im).alias("x_im"),
        F.avg(c.power(near_bin())).alias("nn"), F.avg(c.power(far_bin())).alias("ff"),
    )
    value = coherence_of(cx("x"), F.col("nn"), F.col("ff"), s.eps)
    return means.select("clip_no", "bin", "last_block", value.alias("static_coherence"))


def powers(m: Matrices) -> Matrices:
    """Cross power near * conj(far) and both powers of a block's matrices."""
    return {
        "re": m["near_re"] * m["far_re"] + m["near_im"] * m["far_im"], "im": m["near_im"] * m["far_re"] - m["near_re"] * m["far_im"],
        "near": m["near_re"] ** 2 + m["near_im"] ** 2, "far": m["far_re"] ** 2 + m["far_im"] ** 2,
    }


def bounded_coherence(m: Matrices, eps: float) -> np.ndarray:
    return np.clip((m["re"] ** 2 + m["im"] ** 2) / (m["near"] * m["far"] + eps), 0.0, 1.0)


def ema(alpha: float, outputs: tuple[str, ...], finish) -> Recurrence:
    """Causal averages of cross power and both powers, seeded with the first frame; ``finish(matrices, averages)`` gives the outputs."""
    if not 0.0 <= alpha < 1.0:
        raise ValueError("alpha must lie in [0, 1)")

    def step(m: Matrices, frame: np.ndarray) -> tuple[np.ndarray, Matrices]:
        fresh = np.where(frame == 0, 1.0, 1.0 - alpha)[:, None]
        return np.full(m["near_re"].shape, alpha), {n: fresh * v for n, v in powers(m).items()}

    return Recurrence(("re", "im", "near", "far"), step, outputs, lambda m, after, before: finish(m, after))


def causal_coherence(s: Settings) -> Recurrence:
    return ema(s.coherence_alpha, ("coherence",), lambda m, averages: {"coherence": bounded_coherence(averages, s.eps)})


def adaptive(s: Settings) -> Recurrence:
    """Adaptive coefficient after (``after_*``) and before (``before_*``) each frame's update.

    The update is linear in the coefficient: w' = w (1 - step |far|^2 / norm) + step conj(far) near / norm.
    """
    if s.adaptive_step <= 0.0:
        raise ValueError("adaptive_step must be positive")

    def step(m: Matrices, frame: np.ndarray) -> tuple[np.ndarray, Matrices]:
        p = powers(m)
        norm = p["far"] + s.eps
        return 1.0 - s.adaptive_step * p["far"] / norm, {n: s.adaptive_step / norm * p[n] for n in ("re", "im")}

    return Recurrence(
        ("re", "im"), step, ("after_re", "after_im", "before_re", "before_im"),
        lambda m, after, before: {f"{w}_{n}": v[n] for w, v in (("after", after), ("before", before)) for n in ("re", "im")},
    )


def prepared(packed: DataFrame, names, s: Settings = Settings(), coherence: bool = False) -> DataFrame:
    """Long spectra with every extra column the named front-ends need; one pass for all of them."""
    needs = {n for name in names for n in frontend(name).needs}
    arrays = list(PACKED)
    if "static_coherence" in needs:
        packed = attach_bins(packed, static_coherence(packed, s), ["static_coherence"])
        arrays.append("static_coherence")
    parts = ([causal_coherence(s)] if coherence else []) + ([adaptive(s)] if "adaptive" in needs else [])
    if parts:
        packed = scan(packed, parts, PACKED, s.block)
        arrays += [n for part in parts for n in part.outputs]
    return explode_bins(packed, arrays)


def apply(packed: DataFrame, name: str, s: Settings = Settings()) -> DataFrame:
    """View rows of one front-end with coherence, energy ratio and its own diagnostics."""
    fe = frontend(name)
    long = prepared(packed, [name], s, coherence=True)
    extra = {n: f(s) for n, f in fe.diagnostics.items()}
    ratio = c.power(fe.primary(s)) / F.greatest(c.power(near_bin()), d(s.eps))
    views = F.array(
        *[
            F.struct(F.lit(v).alias("view"), f(s).re.alias("re"), f(s).im.alias("im"))
            for v, f in fe.views.items()
        ]
    )
    return long.select(
        "clip_no", "block", "frame", "bin", "coherence", ratio.alias("view_to_near_energy_ratio"),
        *[v.alias(n) for n, v in extra.items()], F.inline(views),
    )


def spectral_summaries(packed: DataFrame, names, s: Settings = Settings()) -> DataFrame:
    """Mean and population deviation of log1p magnitude per (clip_no, frontend, view, bin).

    All front-ends are summarised side by side in one aggregation over one pass of the spectra (the rows are
    not multiplied by the front-ends); only the small result is unpivoted.
    """
    wanted = [(n, v, f(s)) for n in names for v, f in frontend(n).views.items()]
    long = prepared(packed, names, s)
    # The same view may serve several front-ends (near alone, concatenated, fused): aggregate it once.
    distinct: dict[str, tuple[str, Cx]] = {}
    for _, v, z in wanted:
        distinct.setdefault(v, (f"v{len(distinct)}", z))
    aggs = []
    for column, z in distinct.values():
        value = F.log1p(c.magnitude(z))
        aggs += [F.avg(value).alias(f"{column}_m"), F.stddev_pop(value).alias(f"{column}_s")]
    wide = long.groupBy("clip_no", "bin").agg(*aggs)
    rows = [
        F.struct(
            F.lit(n).alias("frontend"), F.lit(v).alias("view"),
            F.col(f"{distinct[v][0]}_m").alias("mean"), F.col(f"{distinct[v][0]}_s").alias("std"),
        )
        for n, v, _ in wanted
    ]
    return wide.select("clip_no", "bin", F.inline(F.array(*rows)))


def energy_audit(packed: DataFrame, names, bins: int, s: Settings = Settings()) -> DataFrame:
    """Per (clip_no, frontend): median primary-view energy ratio and the fraction of cells below 0.2."""
    cells = F.col("frames") * bins
    near = F.greatest(c.power(near_bin()), d(s.eps))
    # Front-ends with the same primary view share one ratio.
    views = {n: next(iter(frontend(n).views)) for n in names}
    ratios = {v: (f"r{i}", c.power(frontend(n).primary(s)) / near) for i, (v, n) in enumerate({v: n for n, v in views.items()}.items())}

    # Usual clips: every ratio side by side, one aggregation over one pass (its buffers hold at most AUDITED cells).
    wide = prepared(packed.where(cells <= AUDITED), names, s).select("clip_no", *[x.alias(r) for r, x in ratios.values()])
    low = lambda r: F.avg((F.col(r) < d(0.2)).cast("double"))
    both = [x for r, _ in ratios.values() for x in (low(r).alias(f"{r}_b"), F.percentile(r, F.lit(0.5)).alias(f"{r}_m"))]
    rows = F.array(*[
        F.struct(
            F.lit(n).alias("frontend"), F.col(f"{ratios[v][0]}_b").alias("fraction_below_0_2"), F.col(f"{ratios[v][0]}_m").alias("median_energy_ratio")
        )
        for n, v in views.items()
    ])
    short = wide.groupBy("clip_no").agg(*both).select("clip_no", F.inline(rows))

    # Very long clips: the same numbers with bracketed medians.
    each = F.array(*[F.struct(F.lit(n).alias("frontend"), ratios[v][1].alias("ratio")) for n, v in views.items()])
    long = prepared(packed.where(cells > AUDITED), names, s).select("clip_no", F.inline(each))
    keys = ["clip_no", "frontend"]
    lengthy = long.groupBy(*keys).agg(low("ratio").alias("fraction_below_0_2")).join(
        quantiles(long, keys, "ratio", {"median_energy_ratio": 0.5}), keys
    )
    return short.unionByName(lengthy)
