"""Settings as plain nested dicts, with values that mean 'not set', and the registry of builders."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from typing import Any

import re

TRUE = frozenset({"1", "true", "yes", "y", "on"})


def is_unset(value: Any, sentinels: Iterable[Any] = ("", "none", None)) -> bool:
    """Null, blank, or one of the sentinels in any case."""
    if isinstance(value, str):
        plain = value.strip().lower()
        return not plain or plain in {str(x).strip().lower() for x in sentinels if x is not None}
    return value is None or value in tuple(sentinels)


def resolve(cfg: dict, key: str, default: Any = None, sentinels: Iterable[Any] = ("", "none", None)) -> Any:
    """V6: data.key unless it is unset, then experiment.data.key (or the default without one) unless that is, then data.key as it stands."""
    sentinels = tuple(sentinels)
    top = (cfg.get("data") or {}).get(key, default)
    if not is_unset(top, sentinels):
        return top
    own = ((cfg.get("experiment") or {}).get("data") or {}).get(key, default)
    return top if is_unset(own, sentinels) else own


def as_int(cfg: dict, key: str, default: int) -> int:
    return int(resolve(cfg, key, default))


def as_float(cfg: dict, key: str, default: float) -> float:
    return float(resolve(cfg, key, default))


def as_bool(cfg: dict, key: str, default: bool) -> bool:
    """V8: text is true if it is one of TRUE."""
    value = resolve(cfg, key, default)
    return value.strip().lower() in TRUE if isinstance(value, str) else bool(value)


def names(cfg: dict, key: str, default: list[str]) -> list[str]:
    """V8: a list, or a text of names between commas."""
    value = resolve(cfg, key, default)
    return [x for x in (str(x).strip() for x in (value.split(",") if isinstance(value, str) else value)) if x]


def shard_ids(value: Any, n: int) -> list[int]:
    """V7: unset or 'all' is every shard; else a list, or numbers between commas."""
    if is_unset(value) or isinstance(value, str) and value.strip().lower() == "all" or value == []:
        return list(range(n))
    return [int(x) for x in (value.split(",") if isinstance(value, str) else value) if str(x).strip()]


def manifest_paths(out: str, artifact: str = "") -> dict[str, str]:
    """The paths of a synthetic-image run; a name for the artifact puts them in a folder of its own."""
    base = PurePosixPath(out)
    if artifact:
        safe = re.sub(r"[^A-Za-z0-9_.=-]+", "_", artifact).strip("._")
        if not safe:
            raise ValueError(f"unfit artifact name: {artifact!r}")
        base = base / "artifacts" / safe
    # Names of the tables.
    tables = (
        "eligible_train_pool", "generation_prompts", "synthetic_candidates_manifest", "synthetic_qc_manifest", "synthetic_selected_manifest", "source_study_status",
        "train_real_baseline_manifest", "train_synthetic_pretrain_manifest", "train_real_finetune_manifest",
    )
    return {"artifact_dir": str(base), "images_raw": str(base / "images_raw")} | {t: str(base / "manifests" / t) for t in tables}


@dataclass
class Registry:
    """Builders by name, in any case; a name can't be taken twice."""

    kind: str
    entries: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str) -> Callable[[Callable], Callable]:
        def put(f: Callable) -> Callable:
            if name.lower() in self.entries:
                raise KeyError(f"{self.kind} {name!r} is registered already")
            self.entries[name.lower()] = f
            return f

        return put

    def get(self, name: str) -> Callable:
        if name.lower() not in self.entries:
            raise KeyError(f"no {self.kind} {name!r}; there are {sorted(self.entries)}")
        return self.entries[name.lower()]


# Limits of the image augmentations, mild and strong.
MILD = {"rotate": 3, "shift": 0.02, "scale": 0.05, "brightness_contrast": 0.10, "gamma": (90, 110), "noise_std": (0.01, 0.02), "noise_p": 0.5, "blur": (3, 5)}
STRONG = {"rotate": 8, "shift": 0.2, "scale": 0.15, "brightness_contrast": 0.30, "gamma": (80, 120), "noise_std": (0.04, 0.08), "noise_p": 0.9, "blur": (3, 7)}
#: What each image augmentation mode consists of.
IMAGE_MODES = {"none": (), "geo": ("shift_scale_rotate",), "photo": ("brightness_contrast", "gamma", "noise"), "mix": ("shift_scale_rotate", "brightness_contrast", "gamma"), "strong": ("shift_scale_rotate", "brightness_contrast", "gamma", "noise", "blur")}


def image_recipe(mode: str | None) -> dict[str, Any] | None:
    """The steps and limits of a mode, for an image augmentation plug-in; None for none. An unknown mode raises ValueError."""
    name = mode or "none"
    if name not in IMAGE_MODES:
        raise ValueError(f"unknown image mode: {mode!r}")
    return {"steps": IMAGE_MODES[name], **(STRONG if name == "strong" else MILD)} if IMAGE_MODES[name] else None


#: V9: presets that are passed to a generator plug-in.
GENERATION = {"greedy": {"do_sample": False, "num_beams": 1}, "beam": {"do_sample": False, "num_beams": 4}, "sample": {"do_sample": True, "num_beams": 1}, "guarded": {"do_sample": False, "num_beams": 1, "no_repeat_ngram_size": 6}}
