"""Activations and closed-form formulas as column expressions, which stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.exprs import div, num


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-num(x)))


def softplus(x) -> Column:
    """Without overflow: the larger of x and 0 plus a logarithm of what is left."""
    x = num(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


ACTIVATIONS = {
    "relu": lambda x: F.greatest(num(x), F.lit(0.0)), "leaky_relu": lambda x: F.when(num(x) > 0, num(x)).otherwise(0.01 * num(x)),
    "elu": lambda x: F.when(num(x) > 0, num(x)).otherwise(F.exp(num(x)) - 1.0), "sigmoid": sigmoid, "tanh": lambda x: F.tanh(num(x)), "softplus": softplus,
    "softsign": lambda x: num(x) / (1.0 + F.abs(num(x))), "swish": lambda x: num(x) * sigmoid(x), "mish": lambda x: num(x) * F.tanh(softplus(x)),
    "gelu": lambda x: 0.5 * num(x) * (1.0 + F.tanh(math.sqrt(2 / math.pi) * (num(x) + 0.044715 * num(x) * num(x) * num(x)))),
    "hard_sigmoid": lambda x: F.least(F.greatest(num(x) / 6.0 + 0.5, F.lit(0.0)), F.lit(1.0)), "step": lambda x: F.when(num(x) > 0, 1.0).otherwise(0.0),
}

#: Fixed values of nature in SI units.
G, C, H, K_B, R_GAS, K_E, E_0, SIGMA = 6.67430e-11, 299792458.0, 6.62607015e-34, 1.380649e-23, 8.314462618, 8.9875517923e9, 8.8541878128e-12, 5.670374419e-8

FORMULAS = {
    "kinetic_energy": lambda m, v: 0.5 * num(m) * num(v) * num(v), "momentum": lambda m, v: num(m) * num(v), "gravity_force": lambda m, n, r: div(G * num(m) * num(n), num(r) * num(r)),
    "escape_velocity": lambda m, r: F.sqrt(div(2 * G * num(m), r)), "orbital_period": lambda m, a: 2 * math.pi * F.sqrt(div(num(a) * num(a) * num(a), G * num(m))),
    "pendulum_period": lambda length: 2 * math.pi * F.sqrt(num(length) / 9.80665), "spring_period": lambda m, k: 2 * math.pi * F.sqrt(div(m, k)),
    "lorentz_factor": lambda v: div(1.0, F.sqrt(1.0 - num(v) * num(v) / (C * C))), "rest_energy": lambda m: num(m) * C * C, "photon_energy": lambda f: H * num(f),
    "de_broglie": lambda p: div(H, p), "coulomb_force": lambda q, s, r: div(K_E * num(q) * num(s), num(r) * num(r)), "capacitor_energy": lambda c, v: 0.5 * num(c) * num(v) * num(v),
    "ohm_power": lambda v, r: div(num(v) * num(v), r), "ideal_gas_volume": lambda n, t, p: div(num(n) * R_GAS * num(t), p), "rms_speed": lambda t, m: F.sqrt(div(3 * R_GAS * num(t), m)),
    "carnot": lambda hot, cold: 1.0 - div(cold, hot), "stefan_boltzmann": lambda e, a, t: num(e) * SIGMA * num(a) * num(t) * num(t) * num(t) * num(t), "wien_peak": lambda t: div(2.897771955e-3, t),
    "doppler": lambda f, v, c: div(num(f) * num(c), num(c) - num(v)), "snell": lambda n1, n2, a: F.asin(div(n1, n2) * F.sin(num(a))), "thin_lens": lambda f, d: div(1.0, div(1.0, f) - div(1.0, d)),
    "reynolds": lambda rho, v, length, mu: div(num(rho) * num(v) * num(length), mu), "bernoulli": lambda p, rho, v, h: num(p) + 0.5 * num(rho) * num(v) * num(v) + num(rho) * 9.80665 * num(h),
    "half_life_left": lambda n, t, half: num(n) * F.pow(F.lit(2.0), -div(t, half)), "schwarzschild_radius": lambda m: 2 * G * num(m) / (C * C),
}
