"""Checks of one row for :mod:`isolated`; a light module, since each child process imports it."""

from __future__ import annotations

import contextlib
import copy
import itertools
import math
from dataclasses import dataclass, field

from ..functions.fixed import INPUTS_SEED, WEIGHTS_SEED


def parses(row: dict) -> str | None:
    """A check that needs nothing but the parser: compiles the text, runs nothing."""
    compile(row["python_code"] or "", "<row>", "exec", dont_inherit=True)
    return None


def _finite(value) -> bool:
    """Whether all numbers of a tensor, array, number or nested list are finite."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return all(_finite(v) for v in value)
    return not isinstance(value, float) or math.isfinite(value)


def _plain(value):
    return value.tolist() if hasattr(value, "tolist") else value


@dataclass
class _Trial:
    """What the stages of one run pass on."""

    row: dict
    space: dict = field(default_factory=dict)
    model: object = None
    outputs: list = field(default_factory=list)


def _torch():
    try:
        import torch
    except ImportError:
        return None
    return torch


def _seed(value: int) -> None:
    if torch := _torch():
        torch.manual_seed(value)


def _loads(t: _Trial) -> None:
    t.space["__name__"] = "row"
    exec(compile(t.row["python_code"], "<row>", "exec"), t.space)


def _builds(t: _Trial) -> None:
    args, kwargs = t.space["get_init_inputs"]()
    _seed(WEIGHTS_SEED)
    t.model = t.space[t.row["module_name"].strip()](*args, **kwargs)


def _has_finite_weights(t: _Trial) -> str | None:
    held = itertools.chain.from_iterable(getattr(t.model, name)() for name in ("parameters", "buffers") if hasattr(t.model, name))
    if all(_finite(_plain(w.detach() if hasattr(w, "detach") else w)) for w in held):
        return None
    return "init: weights are not finite"


def _runs_twice(t: _Trial) -> None:
    if hasattr(t.model, "eval"):
        t.model.eval()
    _seed(INPUTS_SEED)
    inputs, torch = t.space["get_inputs"](), _torch()
    with torch.no_grad() if torch else contextlib.nullcontext():
        while len(t.outputs) < 2:
            t.outputs.append(t.model(*copy.deepcopy(inputs)))


def _gives_an_array(t: _Trial) -> str | None:
    return None if hasattr(t.outputs[0], "shape") else f"output: {type(t.outputs[0]).__name__}, not one array"


def _is_finite(t: _Trial) -> str | None:
    return None if _finite(t.outputs[0]) else "output: not finite"


def _repeats(t: _Trial) -> str | None:
    return None if _plain(t.outputs[0]) == _plain(t.outputs[1]) else "nondeterministic: two calls differ"


#: The stages of a run in order; the first that objects gives the reason.
STAGES = (_loads, _builds, _has_finite_weights, _runs_twice, _gives_an_array, _is_finite, _repeats)


def runs_deterministically(row: dict) -> str | None:
    """A check that RUNS the row's code; only for :func:`isolated.isolated_map`, never in a long-lived process.

    The text must define ``get_init_inputs() -> [args, kwargs]``, ``get_inputs() -> list`` and the class named in
    module_name.  In order: it loads, builds, its weights are finite, it runs twice on equal inputs, gives one array
    (anything with a shape), finite and equal both times.  With torch installed, seeds are set and no gradients kept.
    """
    trial = _Trial(row)
    return next((reason for stage in STAGES if (reason := stage(trial))), None)
