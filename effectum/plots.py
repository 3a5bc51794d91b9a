"""Plots of small results. They need matplotlib, which is looked for only when one is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _axes():
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("plots need matplotlib") from e
    return plt.subplots()[1]


def hte_plot(curves: dict[str, DataFrame]):
    """Gain over the share treated, of one or more lift curves."""
    ax = _axes()
    for name, c in curves.items():
        rows = c.orderBy("ratio").select("ratio", "gain").collect()
        ax.plot([r[0] for r in rows], [r[1] for r in rows], label=name)
    ax.legend()
    return ax


def matching_plot(df: DataFrame, treatment: str, column: str, bins: int = 40):
    """The distribution of a column in both arms; only bin counts leave Spark."""
    from .operators.features import histogram

    ax = _axes()
    for arm in (0, 1):
        rows = histogram(df.where(F.expr(treatment).cast("int") == arm), column, bins).orderBy("from").collect()
        n = sum(r["n"] for r in rows) or 1
        ax.step([r["from"] for r in rows], [r["n"] / n for r in rows], label=str(arm))
    ax.legend()
    return ax


def draw_heatmap(correlations: DataFrame):
    """A matrix of correlations (a, b, corr)."""
    rows = correlations.collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    grid = [[0.0] * len(names) for _ in names]
    for r in rows:
        grid[at[r["a"]]][at[r["b"]]] = grid[at[r["b"]]][at[r["a"]]] = r["corr"]
    ax = _axes()
    ax.imshow(grid, vmin=-1, vmax=1)
    ax.set_xticks(range(len(names)), names, rotation=90)
    ax.set_yticks(range(len(names)), names)
    return ax


def tree_dot(tree) -> str:
    """A causal tree in the language of graphviz."""
    lines = ["digraph tree {"]
    for n in tree.nodes:
        text = f"{n.split[0]} <= {n.split[1]:g}" if n.split else f"effect {n.effect:.4g}"
        lines.append(f'  n{n.id} [label="{text}\\nn={n.n}"];')
        lines += [f"  n{n.id} -> n{c};" for c in n.children]
    return "\n".join([*lines, "}"])
