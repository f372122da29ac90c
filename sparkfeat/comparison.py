"""Comparison of feature-engineering tools over data sets: what each gained, in what time, and how often it won."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import mean

from .operators.splits import wilcoxon


@dataclass(frozen=True)
class Run:
    """One tool on one data set: scores before and after it, a score for each fold, and seconds it took."""

    tool: str
    dataset: str
    before: tuple[float, ...]
    after: tuple[float, ...]
    seconds: float

    @property
    def gain(self) -> float:
        """Relative change of the mean score, in percent."""
        b, a = mean(self.before), mean(self.after)
        return 100 * (a - b) / max(abs(b), 1e-12)


def summary(runs: list[Run], tolerance: float = 0.5) -> dict[str, dict[str, float]]:
    """By tool: data sets, mean gain, wins, ties (within ``tolerance`` percent) and losses, significant ones, mean seconds, and the share of data sets covered."""
    every = {r.dataset for r in runs}
    out = {}
    for tool in dict.fromkeys(r.tool for r in runs):
        mine = [r for r in runs if r.tool == tool]
        won, lost = sum(r.gain > tolerance for r in mine), sum(r.gain < -tolerance for r in mine)
        out[tool] = {"datasets": len(mine), "mean_gain": mean(r.gain for r in mine), "wins": won, "ties": len(mine) - won - lost, "losses": lost, "significant": sum(wilcoxon(list(r.after), list(r.before)) < 0.05 for r in mine), "seconds": mean(r.seconds for r in mine), "coverage": len({r.dataset for r in mine}) / len(every)}
    return out


def report(runs: list[Run]) -> str:
    """The summary and every run as Markdown."""
    s = summary(runs)
    lines = ["# Comparison", "", "| Tool | Data sets | Mean gain % | W/T/L | Significant | Seconds | Coverage |", "|-|-|-|-|-|-|-|"]
    lines += [f"| {t} | {v['datasets']} | {v['mean_gain']:+.2f} | {v['wins']}/{v['ties']}/{v['losses']} | {v['significant']} | {v['seconds']:.2f} | {v['coverage']:.0%} |" for t, v in sorted(s.items(), key=lambda x: -x[1]["mean_gain"])]
    lines += ["", "| Data set | Tool | Before | After | Gain % | Seconds |", "|-|-|-|-|-|-|"]
    lines += [f"| {r.dataset} | {r.tool} | {mean(r.before):.4f} | {mean(r.after):.4f} | {r.gain:+.2f} | {r.seconds:.2f} |" for r in sorted(runs, key=lambda r: (r.dataset, r.tool))]
    return "\n".join(lines) + "\n"
