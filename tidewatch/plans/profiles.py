"""Sampler settings by profile, and what a run does whose chains have not converged."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from typing import Any

LOG = logging.getLogger(__name__)
# The settings that a profile may change, and the profiles.
KEYS = ["chains", "pymc_cores", "tune", "draws", "target_accept", "max_treedepth", "bayesian_progress"]
PROFILES = ["cv", "final", "dev"]
#: With fewer chains or draws the diagnostics say little.
LEAST_CHAINS, LEAST_DRAWS = 2, 50


def profile_mode(raw: Any) -> str | None:
    """A known profile's name; None (each fit takes its own) for nothing, auto and unknown names."""
    name = str(raw or "").strip().lower()
    if name and name not in (*PROFILES, "auto", "default", "none"):
        LOG.warning("no profile %s; each fit takes its own", name)
    return name if name in PROFILES else None


def settings(base: Mapping[str, Any], profiles: Mapping[str, Any] | None = None, mode: str | None = None) -> dict[str, Any]:
    """``final`` and ``cv``: the settings of the whole fit and of the folds, with the profiles laid over
    ``base``; ``differ``: the keys in which they differ; ``missing``: profiles that were asked for and are
    not there. One profile for both if ``mode`` names it; folds without a profile take the final one's."""
    given = profiles if isinstance(profiles, Mapping) else {}
    over = {p: {k: v for k, v in given[p].items() if k in KEYS} if isinstance(given.get(p), Mapping) else {} for p in PROFILES}
    one = profile_mode(mode)
    whole, folds = (one, one) if one else ("final", "cv")
    final, cv = {**base, **over[whole]}, {**base, **(over[folds] or ({} if one else over["final"]))}
    return {"final": final, "cv": cv, "differ": sorted(k for k in KEYS if final.get(k) != cv.get(k)), "missing": sorted({p for p in (whole, folds) if not over[p]})}


def convergence_mode(values: Mapping[str, Any], strict: bool) -> tuple[str, str | None]:
    """``strict`` or ``warn``, and why if the settings decided it: what ``convergence_failure_mode`` says
    (unknown words count as strict), else ``warn`` for few chains or draws, else as ``strict`` asks."""
    said = values.get("convergence_failure_mode")
    if said is not None:
        word = str(said).strip().lower()
        return (word if word in ("strict", "warn") else "strict"), None
    chains, draws = int(values.get("chains") or 0), int(values.get("draws") or 0)
    if chains < LEAST_CHAINS or draws < LEAST_DRAWS:
        return "warn", f"few samples (chains={chains}, draws={draws})"
    return ("strict" if strict else "warn"), None


def enforce(ok: bool, mode: str) -> bool:
    """``ok``; an error under ``strict`` and a warning under ``warn`` where it is false."""
    if not ok and mode == "strict":
        raise ValueError("the chains have not converged")
    if not ok:
        LOG.warning("the chains have not converged")
    return ok
