"""Hypergeometric tail and set similarity as JVM-side expressions.

The tail is written as SQL text: one parse instead of hundreds of driver calls. ``transform`` over a
one-element array binds intermediate values, so nothing is evaluated twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def _series(z: str) -> str:
    """Stirling's series for ln Gamma(z), good to double precision for z >= 10."""
    w = f"(1D/({z}*{z}))"
    tail = f"(1D/12-{w}*(1D/360-{w}*(1D/1260-{w}*(1D/1680-{w}/1188D))))/{z}"
    return f"(({z}-0.5D)*ln({z})-{z}+{_HALF_LOG_2PI!r}D+{tail})"


def log_gamma(x: str) -> str:
    """SQL for ln Gamma(x), x >= 1: small arguments are shifted up by ten."""
    shift = "+".join(f"ln({x}+{i}D)" for i in range(10))
    return f"CASE WHEN {x}>15D THEN {_series(x)} ELSE {_series(f'({x}+10D)')}-({shift}) END"


def _let(bindings: dict[str, str], name: str, body: str) -> str:
    fields = ",".join(f"'{k}',{v}" for k, v in bindings.items())
    return f"element_at(transform(array(named_struct({fields})),{name}->{body}),1)"


def _log_point(i: str) -> str:
    """SQL for ln P(X = i) with pop/succ/draws bound in ``s``; the series appears once, inside a lambda."""
    plus = ["s.succ", "s.pop-s.succ", "s.draws", "s.pop-s.draws"]
    minus = [i, f"s.succ-{i}", f"s.draws-{i}", f"s.pop-s.succ-s.draws+{i}", "s.pop"]
    args = ",".join(f"double(1+{v})" for v in plus + minus)
    return (f"aggregate(transform(array({args}),(x,j)->(CASE WHEN j<4 THEN 1D ELSE -1D END)*({log_gamma('x')})),"
            "0D,(a,v)->a+v)")


def _sum_terms(steps: str, ratio: str) -> str:
    """SQL for 1 + r1 + r1*r2 + ... over ``steps`` term ratios (``i`` counts from 1)."""
    return (f"aggregate(IF({steps}>0,sequence(1L,{steps}),array()),named_struct('t',1D,'z',1D),"
            f"(a,i)->named_struct('t',a.t*({ratio}),'z',a.z+a.t*({ratio})),a->a.z)")


def hypergeom_sf(k: str, pop: str, succ: str, draws: str) -> Column:
    """P(X >= k) for ``draws`` from ``pop`` items of which ``succ`` are successes (arguments: column names).

    The terms are log-concave, so from the mode outwards the s-th term is below
    exp(-2 s^2 / (min(succ, draws) + 1)) of the first one: 5 sqrt(min + 1) terms reach double precision
    however large the set is. Above the mode the upper tail is summed, otherwise one minus the lower one.
    """
    up = _sum_terms("least(t.top-t.lo,t.reach)",
                    "double(s.succ-t.lo-i+1)*double(s.draws-t.lo-i+1)"
                    "/(double(t.lo+i)*double(s.pop-s.succ-s.draws+t.lo+i))")
    down = _sum_terms("least(t.lo-1-t.bottom,t.reach)",
                      "double(t.lo-i)*double(s.pop-s.succ-s.draws+t.lo-i)"
                      "/(double(s.succ-t.lo+1+i)*double(s.draws-t.lo+1+i))")
    body = ("CASE WHEN t.lo>t.top THEN IF(s.k>t.top,0D,1D) WHEN t.lo=0 OR t.lo-1<t.bottom THEN 1D "
            f"WHEN t.lo>t.mode THEN least(1D,exp({_log_point('t.lo')}+ln({up}))) "
            f"ELSE least(1D,greatest(0D,1D-exp({_log_point('(t.lo-1)')}+ln({down})))) END")
    inner = _let({"lo": "greatest(s.k,0L,s.draws-(s.pop-s.succ))", "top": "least(s.succ,s.draws)",
                  "bottom": "greatest(0L,s.draws-(s.pop-s.succ))",
                  "mode": "bigint(floor(double(s.draws+1)*double(s.succ+1)/double(s.pop+2)))",
                  "reach": "bigint(5*sqrt(double(least(s.succ,s.draws)+1)))+2"}, "t", body)
    names = {"k": k, "pop": pop, "succ": succ, "draws": draws}
    return F.expr(_let({n: f"bigint(`{c}`)" for n, c in names.items()}, "s", inner))


def jaccard(shared: Column, n_a: Column, n_b: Column) -> Column:
    union = n_a + n_b - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def overlap_coefficient(shared: Column, n_a: Column, n_b: Column) -> Column:
    small = F.least(n_a, n_b)
    return F.when(small > 0, shared / small).otherwise(F.lit(0.0))
