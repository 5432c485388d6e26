"""Composable, traceable and invertible transforms of batches.

A Batch has arrays by key and a trace: the steps applied so far, with their parameters, as plain data.
`Compose` folds steps over a batch, so a whole pipeline is one logical plan; its inverse undoes the
trace's invertible steps from the end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from ..operators import augment, intensity, spatial
from ..voxels import Voxels


@dataclass(frozen=True)
class Batch:
    arrays: dict[str, Voxels]
    trace: tuple[dict, ...] = ()

    def __getitem__(self, key: str) -> Voxels:
        return self.arrays[key]


@dataclass(frozen=True)
class Step:
    """One operator on some keys; undo gets the traced state that `keep` took before."""

    name: str
    keys: Sequence[str]
    apply: Callable[[Voxels], Voxels]
    undo: Callable[[Voxels, object], Voxels] | None = None
    keep: Callable[[Voxels], object] = lambda vox: None
    params: dict = field(default_factory=dict)
    allow_missing: bool = False

    def __post_init__(self) -> None:
        if isinstance(self.keys, str):
            object.__setattr__(self, "keys", (self.keys,))
        if not self.keys:
            raise ValueError("a step needs keys")
        if not all(isinstance(k, str) for k in self.keys):
            raise TypeError("keys are strings")

    def __call__(self, batch: Batch) -> Batch:
        missing = [k for k in self.keys if k not in batch.arrays]
        if missing and not self.allow_missing:
            raise KeyError(f"{self.name}: no {missing}")
        here = [k for k in self.keys if k in batch.arrays]
        entry = {"name": self.name, "params": self.params, "invertible": self.undo is not None, "kept": {k: self.keep(batch[k]) for k in here}, "step": self}
        return replace(batch, arrays=batch.arrays | {k: self.apply(batch[k]) for k in here}, trace=(*batch.trace, entry))


class Compose:
    """Steps in order; nested compositions are flattened."""

    def __init__(self, *steps: Step | Compose) -> None:
        self.steps = [s for x in steps for s in (x.steps if isinstance(x, Compose) else [x])]

    def __call__(self, batch: Batch) -> Batch:
        for step in fused(self.steps):
            batch = step(batch)
        return batch

    @staticmethod
    def inverse(batch: Batch) -> Batch:
        """Undo the trace from its end; steps without an inverse stay as they are."""
        arrays = dict(batch.arrays)
        for entry in reversed(batch.trace):
            if entry["invertible"]:
                for k, kept in entry["kept"].items():
                    arrays[k] = entry["step"].undo(arrays[k], kept)
        return Batch(arrays)


def fused(steps: Sequence[Step]) -> list[Step]:
    """Without steps that do nothing, and pairs that cancel out."""
    out: list[Step] = []
    for s in steps:
        if s.params.get("nothing"):
            continue
        if out and s.name == out[-1].name == "flip" and s.params == out[-1].params and list(s.keys) == list(out[-1].keys):
            out.pop()
            continue
        out.append(s)
    return out


def flip(keys: Sequence[str], *axes: str) -> Step:
    return Step("flip", keys, lambda v: spatial.flip(v, *axes), lambda v, _: spatial.flip(v, *axes), params={"axes": axes, "nothing": not axes})


def rotate90(keys: Sequence[str], k: int = 1, plane: tuple[str, str] = ("h", "w")) -> Step:
    return Step("rotate90", keys, lambda v: spatial.rotate90(v, k, plane), lambda v, _: spatial.rotate90(v, -k, plane), params={"k": k, "plane": plane, "nothing": k % 4 == 0})


def shift(keys: Sequence[str], offset: float) -> Step:
    return Step("shift", keys, lambda v: intensity.shift(v, offset), lambda v, _: intensity.shift(v, -offset), params={"offset": offset})


def scale_range(keys: Sequence[str], *limits: float, clipped: bool = False) -> Step:
    a, b = limits[:2]
    loses = clipped or a == b or len(limits) == 4 and limits[2] == limits[3]
    undo = None if loses else lambda v, _: intensity.unscale_range(v, *limits)
    return Step("scale_range", keys, lambda v: intensity.scale_range(v, *limits, clipped=clipped), undo, params={"limits": limits, "clipped": clipped})


def normalize(keys: Sequence[str], **how) -> Step:
    return Step("normalize", keys, lambda v: intensity.normalize(v, **how), params=how)


def crop(keys: Sequence[str], **bounds: tuple[int, int]) -> Step:
    def undo(v: Voxels, shape) -> Voxels:
        return spatial.uncrop(v, shape, **{a: lo for a, (lo, _) in bounds.items()})

    return Step("crop", keys, lambda v: spatial.crop(v, **bounds), undo, lambda v: v.shape, {"bounds": bounds})


def resize(keys: Sequence[str], mode: str = "linear", **sizes: int) -> Step:
    def undo(v: Voxels, shape) -> Voxels:
        return spatial.resize(v, mode, **dict(zip("dhw", shape[:3])))

    return Step("resize", keys, lambda v: spatial.resize(v, mode, **sizes), undo, lambda v: v.shape, {"mode": mode, "sizes": sizes})


def random_flip(keys: Sequence[str], seed: int, prob: float, *axes: str) -> Step:
    run = lambda v: augment.random_flip(v, seed, prob, axes)  # noqa: E731  the same coin again undoes it
    return Step("random_flip", keys, run, lambda v, _: run(v), params={"seed": seed, "prob": prob, "axes": axes})


def mapped(name: str, keys: Sequence[str], fn, inverse=None) -> Step:
    """A Column function of v as a step."""
    from pyspark.sql import functions as F

    undo = None if inverse is None else lambda v, _: v.values(inverse(F.col("v")))
    return Step(name, keys, lambda v: v.values(fn(F.col("v"))), undo)
