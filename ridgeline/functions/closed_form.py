"""Published closed-form workloads as columns, with gradients by forward differentiation of the same formulas.

A formula is written once for anything that has arithmetic: a Column gives values, a Dual also gives derivatives.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.operators.domain import Domain, box


class Dual:
    """A value and its derivatives by some inputs (None: zero)."""

    def __init__(self, value: Column, grads: list[Column | None]):
        self.value, self.grads = value, grads

    def _chain(self, value: Column, slope: Column) -> Dual:
        return Dual(value, [None if g is None else slope * g for g in self.grads])

    @staticmethod
    def _of(other, n: int) -> Dual:
        return other if isinstance(other, Dual) else Dual(F.lit(float(other)), [None] * n)

    def _with(self, other, value, left, right) -> Dual:
        o = self._of(other, len(self.grads))
        grads = []
        for a, b in zip(self.grads, o.grads, strict=True):
            terms = [f(g) for f, g in ((left, a), (right, b)) if g is not None]
            grads.append(sum(terms[1:], terms[0]) if terms else None)
        return Dual(value, grads)

    def __add__(self, o):
        return self._with(o, self.value + self._of(o, len(self.grads)).value, lambda g: g, lambda g: g)

    def __sub__(self, o):
        return self._with(o, self.value - self._of(o, len(self.grads)).value, lambda g: g, lambda g: -g)

    def __mul__(self, o):
        v = self._of(o, len(self.grads)).value
        return self._with(o, self.value * v, lambda g: g * v, lambda g: self.value * g)

    def __truediv__(self, o):
        v = self._of(o, len(self.grads)).value
        return self._with(o, self.value / v, lambda g: g / v, lambda g: -self.value * g / (v * v))

    def __radd__(self, o):
        return self + o

    def __rmul__(self, o):
        return self * o

    def __rsub__(self, o):
        return self._of(o, len(self.grads)) - self

    def __rtruediv__(self, o):
        return self._of(o, len(self.grads)) / self

    def __neg__(self):
        return self * -1.0

    def __pow__(self, k: float):
        return self._chain(F.pow(self.value, F.lit(float(k))), F.lit(float(k)) * F.pow(self.value, F.lit(float(k - 1))))


def _unary(value, slope):
    return lambda x: x._chain(value(x.value), slope(x.value)) if isinstance(x, Dual) else value(x)


sqrt = _unary(F.sqrt, lambda v: 0.5 / F.sqrt(v))
log = _unary(F.log, lambda v: 1.0 / v)
exp = _unary(F.exp, F.exp)
cos = _unary(F.cos, lambda v: -F.sin(v))
sin = _unary(F.sin, F.cos)
tanh = _unary(F.tanh, lambda v: 1.0 - F.tanh(v) * F.tanh(v))


def power(x, k: float):
    return x**k if isinstance(x, Dual) else F.pow(x, F.lit(float(k)))


@dataclass(frozen=True)
class Workload:
    """A domain and a formula from its coordinates to a list of outputs."""

    domain: Domain
    formula: Callable[[list], list]
    outputs: tuple[str, ...] = ("fx",)

    def values(self, x: list[Column]) -> list[Column]:
        return self.formula(x)

    def gradients(self, x: list[Column], normalized: bool = False) -> list[list[Column]]:
        """For each output its derivative by each input; by the normalised inputs if asked."""
        m = len(x)
        duals = [Dual(xi, [F.lit(1.0) if k == i else None for k in range(m)]) for i, xi in enumerate(x)]
        d = self.domain.center_scale()[1] if normalized else [1.0] * m
        return [[F.lit(0.0) if g is None else g / F.lit(s) for g, s in zip(out.grads, d, strict=True)] for out in self.formula(duals)]


def _borehole(x):
    rw, r, tu, hu, tl, hl, length, kw = x
    ratio = log(r / rw)
    return [2 * math.pi * tu * (hu - hl) / (ratio * (1 + 2 * length * tu / (ratio * rw * rw * kw) + tu / tl))]


def _otl(x):
    rb1, rb2, rf, rc1, rc2, beta = x
    gain = beta * (rc2 + 9.0)
    return [(12.0 * rb2 / (rb1 + rb2) + 0.74) * gain / (gain + rf) + 11.35 * rf / (gain + rf) + 0.74 * rf * gain / ((gain + rf) * rc1)]


def _piston(x):
    m, s, v0, k, p0, ta, t0 = x
    a = p0 * s + 19.62 * m - k * v0 / s
    v = s / (2.0 * k) * (sqrt(a * a + 4.0 * k * p0 * v0 / t0 * ta) - a)
    return [2 * math.pi * sqrt(m / (k + s * s * (p0 * v0 / t0) * (ta / (v * v))))]


def _robot_arm(x):
    t, length = x[:4], x[4:]
    angle, u, v = None, None, None
    for ti, li in zip(t, length, strict=True):
        angle = ti if angle is None else angle + ti
        u = li * cos(angle) if u is None else u + li * cos(angle)
        v = li * sin(angle) if v is None else v + li * sin(angle)
    return [sqrt(u * u + v * v)]


def _wing_weight(x):
    sw, wfw, a, lam_deg, q, lam, tc, nz, wdg, wp = x
    c = cos(lam_deg * (math.pi / 180))
    return [0.036 * power(sw, 0.758) * power(wfw, 0.0035) * power(a / (c * c), 0.6) * power(q, 0.006) * power(lam, 0.04) * power(100.0 * tc / c, -0.3) * power(nz * wdg, 0.49) + sw * wp]


def _gearbox(x):
    x1, x2, x4, x5, x6, x7 = x
    x3 = 17.0
    return [
        0.7854 * x1 * x2 * x2 * (3.3333 * x3**2 + 14.9334 * x3 - 43.0934) - 1.5079 * x1 * (x6 * x6 + x7 * x7) + 7.477 * (power(x6, 3) + power(x7, 3)) + 0.7854 * (x4 * x6 * x6 + x5 * x7 * x7),
        27.0 / (x1 * x2 * x2 * x3) - 1.0,
        397.5 / (x1 * x2 * x2 * x3**2) - 1.0,
        1.93 * power(x4, 3) / (x2 * x3 * power(x6, 4)) - 1.0,
        1.93 * power(x5, 3) / (x2 * x3 * power(x7, 4)) - 1.0,
        sqrt(power(745.0 * x4 / x2 / x3, 2) + 16.9e6) / (110.0 * power(x6, 3)) - 1.0,
        sqrt(power(745.0 * x5 / x2 / x3, 2) + 157.5e6) / (85.0 * power(x7, 3)) - 1.0,
        x2 * (x3 / 40.0) - 1.0,
        5.0 * x2 / x1 - 1.0,
        x1 / (12.0 * x2) - 1.0,
        (1.5 * x6 + 1.9) / x4 - 1.0,
        (1.1 * x7 + 1.9) / x5 - 1.0,
    ]


#: Fixed values of the beam: force, length, Young's modulus, Poisson number, shear modulus.
BEAM_F, BEAM_L, BEAM_E, BEAM_NU, BEAM_G = 5e3, 1.5, 216.62e9, 0.27, 86.65e9


def _beam(x):
    b, h = x
    torsion, inertia = (b * b * b * h + b * h * h * h) / 12.0, b * b * b * h / 12.0
    bending = 6 * BEAM_F * BEAM_L / (b * h * h)
    return [
        b * h,
        bending,
        4 * BEAM_F * BEAM_L**3 / (BEAM_E * (b * h * h * h)),
        bending,
        1.5 * BEAM_F / (b * h),
        h / b,
        4 / BEAM_L**2 * sqrt(BEAM_G * torsion * BEAM_E * inertia / (1 - BEAM_NU)),
    ]


def _hartmann(x):
    mu, dpdx, eta, b0 = x
    s = sqrt(eta * mu)
    return [-(dpdx * eta / (b0 * b0)) * (1.0 - b0 / s / tanh(b0 / s)), dpdx / (2.0 * b0) * (1.0 - 2.0 * s / b0 * tanh(b0 / (2.0 * s)))]


def affine(a, shift: float = 0.0) -> Workload:
    return Workload(box([-1] * len(a), [1] * len(a)), lambda x: [sum((ai * xi for ai, xi in zip(a[1:], x[1:], strict=True)), a[0] * x[0]) + shift])


def quadratic(matrix) -> Workload:
    """One half of x' A x."""
    m = len(matrix)

    def formula(x):
        terms = [0.5 * float(matrix[i][j]) * x[i] * x[j] for i in range(m) for j in range(m) if matrix[i][j]]
        return [sum(terms[1:], terms[0])]

    return Workload(box([-1] * m, [1] * m), formula)


def _sine_of_squares(x):
    total = x[0] * x[0]
    for xi in x[1:]:
        total = total + xi * xi
    return [sin(total)]


def _product_peak(x):
    total = None
    for xi in x:
        factor = 1.0 / (4.0 + (xi - 0.5) * (xi - 0.5))
        total = factor if total is None else total * factor
    return [total]


BOREHOLE = Workload(box([0.05, 100, 63070, 990, 63.1, 700, 1120, 9855], [0.15, 50000, 115600, 1110, 116, 820, 1680, 12045], ["r_w", "r", "T_u", "H_u", "T_l", "H_l", "L", "K_w"]), _borehole)
OTL = Workload(box([50, 25, 0.5, 1.2, 0.25, 50], [150, 70, 3, 2.5, 1.2, 300], ["R_b1", "R_b2", "R_f", "R_c1", "R_c2", "beta"]), _otl)
PISTON = Workload(box([30, 0.005, 0.002, 1000, 9e4, 290, 340], [60, 0.02, 0.01, 5000, 1.1e5, 296, 360], ["M", "S", "V_0", "k", "P_0", "T_a", "T_0"]), _piston)
ROBOT_ARM = Workload(box([0] * 8, [2 * math.pi] * 4 + [1] * 4, [f"theta_{i}" for i in range(1, 5)] + [f"L_{i}" for i in range(1, 5)]), _robot_arm)
WING_WEIGHT = Workload(box([150, 220, 6, -10, 16, 0.5, 0.08, 2.5, 1700, 0.025], [200, 300, 10, 10, 45, 1, 0.18, 6, 2500, 0.08], ["S_w", "W_fw", "A", "Lambda", "q", "lambda", "t_c", "N_z", "W_dg", "W_p"]), _wing_weight)
GEARBOX = Workload(box([2.6, 0.7, 7.3, 7.3, 2.9, 5.0], [3.6, 0.8, 8.3, 8.3, 3.9, 5.5]), _gearbox, ("volume", *[f"c{i}" for i in range(1, 12)]))
BEAM = Workload(box([0.005, 0.02], [0.05, 0.25], ["breadth", "height"]), _beam, ("area", "bending", "tip_deflection", "bending_stress", "shear_stress", "area_ratio", "twist_buckling"))
HARTMANN = Workload(box([0.05, 0.5, 0.5, 0.1], [0.2, 3, 3, 1], ["viscosity", "pressure_gradient", "resistivity", "field"]), _hartmann, ("u_ave", "b_ind"))
SINE_OF_SQUARES = Workload(box([0] * 20, [1] * 20), _sine_of_squares)
PRODUCT_PEAK = Workload(box([0] * 20, [1] * 20), _product_peak)
