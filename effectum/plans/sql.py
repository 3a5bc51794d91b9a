"""SQL with statistical pseudo-functions: ``select ttest_2samp(avg(y) / avg(x), t) from table where ...``.

A statement that has a pseudo-function as its only select item is planned as a DataFrame: its source is whatever
stands after FROM (a table, a subquery, joins, a condition), with an optional GROUP BY where the operator knows groups. All other text goes to Spark SQL as it is.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, hypothesis, matching, regression, resampling, uplift

_TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|[A-Za-z_][\w.]*|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+|.", re.DOTALL)


@dataclass
class Call:
    name: str
    args: list[str]
    named: dict[str, str]


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def _at_top(parts: list[str], word: str, begin: int = 0) -> int:
    """The place of a keyword outside parentheses, or -1."""
    depth = 0
    for i in range(begin, len(parts)):
        depth += {"(": 1, ")": -1}.get(parts[i], 0)
        if not depth and parts[i].lower() == word:
            return i
    return -1


def _split(parts: list[str], at: str = ",") -> list[list[str]]:
    out, depth = [[]], 0
    for p in parts:
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(p, 0)
        if p == at and not depth:
            out.append([])
        else:
            out[-1].append(p)
    return out


def _code(parts: list[str]) -> list[str]:
    """The parts that mean something, comments and white space left out."""
    return [p for p in parts if not p.isspace() and not p.startswith(("--", "/*"))]


def parse_call(parts: list[str]) -> Call | None:
    """``name(arg, arg, key=value)``, if that is all there is (but for an alias)."""
    code = [p for p in parts if not p.startswith(("--", "/*"))]
    text = [i for i, p in enumerate(code) if not p.isspace()]
    if len(text) < 3 or code[text[1]] != "(" or code[text[0]].lower() not in FUNCTIONS:
        return None
    depth, stop = 0, None
    for i in range(text[1], len(code)):
        depth += {"(": 1, ")": -1}.get(code[i], 0)
        if not depth:
            stop = i
            break
    rest = _code(code[stop + 1 :]) if stop is not None else ["?"]
    if rest and not (len(rest) <= 2 and (len(rest) == 1 or rest[0].lower() == "as")):
        return None
    args, named = [], {}
    for a in _split(code[text[1] + 1 : stop]):
        own = _code(a)
        if len(own) > 2 and own[1] == "=" and re.fullmatch(r"[A-Za-z_]\w*", own[0]) and own[2] != "=":
            named[own[0].lower()] = "".join(a).split("=", 1)[1].strip()
        elif own:
            args.append("".join(a).strip())
    return Call(code[text[0]].lower(), args, named)


def literal(text: str):
    """A string, number, truth value or list."""
    low = text.strip()
    if low.lower() in ("true", "false"):
        return low.lower() == "true"
    return ast.literal_eval(low)


def _unquoted(text: str) -> str:
    return literal(text) if text[:1] in "'\"" else text


def _options(c: Call, begin: int, *names: str) -> dict:
    """Literal arguments by place and by name."""
    out = {n: literal(v) for n, v in zip(names, c.args[begin:], strict=False)}
    return out | {k: literal(v) for k, v in c.named.items() if k in names}


def _ttest_1samp(df, c, by):
    o = _options(c, 1, "alternative", "mu")
    return hypothesis.ttest_1samp(df, c.args[0], **o, x=_unquoted(c.named.get("x", c.args[3] if len(c.args) > 3 else "''")), by=by)


def _ttest_2samp(df, c, by):
    o = _options(c, 2, "alternative")
    return hypothesis.ttest_2samp(df, c.args[0], c.args[1], **o, x=_unquoted(c.named.get("x", c.args[3] if len(c.args) > 3 else "''")), pse=_unquoted(c.named.get("pse", "''")), by=by)


def _ttests_2samp(df, c, by):
    return hypothesis.ttests_2samp(df, c.args[0], c.args[1], **_options(c, 2, "alternative"), x=_unquoted(c.named.get("x", "''")), by=by)


def _xexpt(df, c, by):
    rest = c.args[4:]
    how: dict = {}
    if rest and rest[0][:1] in "'\"":
        how["metric"] = literal(rest.pop(0))
    if rest and rest[0][:1] == "[":
        how["group_buckets"] = tuple(literal(rest.pop(0)))
    how |= {k: literal(v) for k, v in zip(("alpha", "mde", "power"), rest, strict=False)}
    how |= {k: literal(v) for k, v in c.named.items() if k in ("metric", "alpha", "mde", "power")}
    return hypothesis.xexpt_ttest_2samp(df, *c.args[:4], x=_unquoted(c.named.get("x", "''")), **how)


def _formula(c: Call) -> tuple[str, dict]:
    return c.args[0], {"use_bias": literal(c.args[-1])} if len(c.args) > 1 and c.args[-1].lower() in ("true", "false") else {}


def _ols(df, c, by):
    f, how = _formula(c)
    return regression.ols(df, f, **how, by=by)


def _wls(df, c, by):
    f, how = _formula(c)
    return regression.wls(df, f, c.args[1], **how, by=by)


def _predict(df, c, by):
    inner = parse_call(tokens(c.args[0]))
    if inner is None or inner.name not in ("ols", "wls"):
        raise ValueError("predict takes ols(...) or wls(...)")
    f, how = _formula(inner)
    model = regression.fit_ols(df, f, **how) if inner.name == "ols" else regression.fit_wls(df, f, inner.args[1], **how)
    rest = c.args[1:]
    if rest and rest[0][:1] in "'\"":
        level = literal(rest[1]) if len(rest) > 1 else 0.95
        return df.withColumn("p", model.interval(literal(rest[0]), level)).select(*df.columns, "p.prediction", "p.lower", "p.upper")
    return model.effect(df, "prediction")


def _list(text: str) -> list[str]:
    """Expressions of a bracketed list, or one."""
    text = text.strip()
    return ["".join(p).strip() for p in _split(tokens(text[1:-1]))] if text[:1] == "[" else [text]


def _dml(kind):
    def plan(df, c, by):
        y, t, x = c.args[:3]
        w = _list(c.args[3]) if len(c.args) > 3 else []
        how = {k: literal(v) for k, v in c.named.items() if k in ("cv",)}
        model = kind(_unquoted(c.named["key"]) if "key" in c.named else "xxhash64(*)", **how).fit(df, y, t, _list(x), w)
        return regression.summary(df, model.model)

    return plan


def _lift(df, c, by):
    k = {"K": literal(c.args[3])} if len(c.args) > 3 else {}
    discrete = {"discrete_treatment": literal(c.args[4])} if len(c.args) > 4 else {}
    return uplift.get_lift_gain(df, *c.args[:3], **k, **discrete, normalize=False)


def _order(c: Call, df: DataFrame) -> list[str]:
    return _list(c.named["order"]) if "order" in c.named else [f"`{n}`" for n in df.columns]


def _caliper(df, c, by):
    return matching.caliper_matching(df, c.args[0], c.args[1], float(literal(c.args[2])), exacts=c.args[3:], order=_order(c, df))


def _exact(df, c, by):
    return matching.exact_matching(df, c.args[0], c.args[1:], order=_order(c, df))


def _cutbins(df, c, by):
    return df.withColumn("bin", features.cut_bins(c.args[0], literal(c.args[1]), **({"if_string": literal(c.args[2])} if len(c.args) > 2 else {})))


def _quantile_bucket(df, c, by):
    if by:
        raise ValueError("quantileTestBucket knows no groups")
    return resampling.quantile_test_bucket(df, c.args[0], c.args[1], literal(c.args[2]), c.args[3], **_options(c, 4, "buckets", "alpha"))


def _boot(df, c, by):
    return resampling.boot_strap(df, _unquoted(c.args[0]), _unquoted(c.named.get("key", "xxhash64(*)")), resample_frac=float(literal(c.args[1])), n_resamples=literal(c.args[2]))


def _perm(df, c, by):
    inner = parse_call(tokens(_unquoted(c.args[0])))
    o = _options(c, 2, "mde", "mde_type")
    return resampling.permutation(df, inner.args[0], inner.args[1], _unquoted(c.named.get("key", "xxhash64(*)")), permutation_num=literal(c.args[1]), statistic="t", **o)


def _forecast(df, c, by):
    a, b = literal(c.args[1])
    model = features.LongTerm(c.named["unit"], c.named["time"], c.named["treatment"], _list(c.args[0]), (a, b), literal(c.args[2]), **_options(c, 3, "key_metric"))
    return model.fit(df).get_results()


#: The pseudo-functions, in lower case.
FUNCTIONS = {
    "deltamethod": lambda df, c, by: hypothesis.delta_method(df, c.args[0], std=literal(c.args[1]) if len(c.args) > 1 else True, by=by),
    "ttest_1samp": _ttest_1samp,
    "ttest_2samp": _ttest_2samp,
    "ttests_2samp": _ttests_2samp,
    "xexpt_ttest_2samp": _xexpt,
    "srm": lambda df, c, by: hypothesis.srm(df, c.args[0], c.args[1], literal(c.args[2])),
    "ols": _ols,
    "wls": _wls,
    "predict": _predict,
    "did": lambda df, c, by: regression.did(df, *c.args),
    "ivregression": lambda df, c, by: regression.iv_regression(df, c.args[0]),
    "lineardml": _dml(uplift.LinearDML),
    "nonparamdml": _dml(uplift.NonParamDML),
    "lift": _lift,
    "calipermatching": _caliper,
    "exactmatching": _exact,
    "cutbins": _cutbins,
    "mannwhitneyutest": lambda df, c, by: hypothesis.mann_whitney_utest(df, c.args[0], c.args[1], **_options(c, 2, "alternative", "continuity_correction")),
    "kolmogorovsmirnovtest": lambda df, c, by: hypothesis.kolmogorov_smirnov_test(df, c.args[0], c.args[1]),
    "pearsonr": lambda df, c, by: hypothesis.pearsonr(df, *c.args, by=by),
    "quantiletestbucket": _quantile_bucket,
    "recursiveforcasting": _forecast,
    "bootstrap": _boot,
    "permutation": _perm,
}


def plan(spark: SparkSession, text: str) -> DataFrame | None:
    """The DataFrame of a statement with a pseudo-function; None if it has none."""
    parts = tokens(text.strip().rstrip(";"))
    select = _at_top(parts, "select")
    source = _at_top(parts, "from", select + 1)
    if select < 0 or source < 0:
        return None
    call = parse_call(parts[select + 1 : source])
    if call is None:
        return None
    group = _at_top(parts, "group", source)
    end = group if group >= 0 else len(parts)
    df = spark.sql("".join(parts[:select]) + "select * from" + "".join(parts[source + 1 : end]))
    by = []
    if group >= 0:
        keys = parts[_at_top(parts, "by", group) + 1 :]
        by = ["".join(k).strip() for k in _split(keys)]
        df = df.withColumns({k: F.expr(k) for k in by if k not in df.columns})
    return FUNCTIONS[call.name](df, call, by)


def sql(spark: SparkSession, text: str) -> DataFrame:
    found = plan(spark, text)
    return spark.sql(text) if found is None else found


def explain(spark: SparkSession, text: str) -> str:
    """The optimised plan of a statement."""
    return sql(spark, text)._jdf.queryExecution().optimizedPlan().toString()
