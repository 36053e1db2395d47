"""Closed-form fields and gas-dynamics formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GAMMA = 1.4


def heat_field(x: Column, y: Column, t: Column, alpha: Column) -> Column:
    """M2: decaying product of sines."""
    two_pi = 2 * math.pi
    return F.sin(two_pi * x) * F.sin(two_pi * y) * F.exp(-8.0 * math.pi**2 * alpha * t)


def vortex_field(x: Column, y: Column, t: Column, gamma: float = GAMMA, angle: float = math.pi / 4) -> list[Column]:
    """M3: isentropic vortex in a free stream: rho, rho u, rho v, E."""
    mach = math.sqrt(2 / gamma)
    beta = mach * 5 * math.sqrt(2) / 4 / math.pi * math.exp(0.5)
    speed = mach * math.sqrt(gamma)
    u0, v0 = speed * math.cos(angle), speed * math.sin(angle)
    dx, dy = x - u0 * t, y - v0 * t
    omega = beta * F.exp(-0.5 * (dx * dx + dy * dy))
    rest = 1 - (gamma - 1) * omega * omega / 2
    rho, u, v = F.pow(rest, F.lit(1 / (gamma - 1))), u0 - dy * omega, v0 + dx * omega
    p = F.pow(rest, F.lit(gamma / (gamma - 1))) / gamma
    return [rho, rho * u, rho * v, p / (gamma - 1) + 0.5 * rho * (u * u + v * v)]


def shock_states(left=(1.0, 1.0, 0.0), right=(0.1, 0.125, 0.0), gamma: float = GAMMA) -> dict[str, float]:
    """M4: the constant states of a shock tube (pressure, density, velocity on each side) and the
    speeds of its waves; one scalar equation for the pressure behind the shock, by bisection."""
    (p_l, rho_l, u_l), (p_r, rho_r, _) = left, right
    c_l, c_r = math.sqrt(gamma * p_l / rho_l), math.sqrt(gamma * p_r / rho_r)
    beta, eps = 2 * gamma / (gamma - 1), 2 * gamma / (gamma + 1)

    def excess(p: float) -> float:
        r = p / p_r - 1
        return p_l * (1 - (c_r / c_l) * r / beta / math.sqrt(1 + r / eps)) ** beta - p

    low, high = p_r, p_l
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) > 0 else (low, mid)
    p2 = (low + high) / 2
    r = p2 / p_r - 1
    root = math.sqrt(1 + r / eps)
    u2, rho2, rho3 = c_r * r / (gamma * root), rho_r * (1 + r / eps) / (1 + r / beta), rho_l * (p2 / p_l) ** (1 / gamma)
    return {"p2": p2, "rho2": rho2, "u2": u2, "rho3": rho3, "fan_left": -c_l, "fan_right": u2 - math.sqrt(gamma * p2 / rho3), "contact": u2, "shock": c_r * root, "c_left": c_l, "p_l": p_l, "rho_l": rho_l, "u_l": u_l, "p_r": p_r, "rho_r": rho_r, "u_r": right[2]}


def classify_intervals(x: Column, bounds: list[tuple[str, Column]], last: str) -> Column:
    """The name of the open interval that x lies in; null on a bound. bounds: names with
    their right ends, ascending."""
    found, begin = None, None
    for name, end in bounds:
        inside = (x < end) if begin is None else (x > begin) & (x < end)
        found = F.when(inside, name) if found is None else found.when(inside, name)
        begin = end
    return found.when(x > begin, last)


def shock_field(x: Column, t: Column, states: dict[str, float], gamma: float = GAMMA) -> dict[str, Column]:
    """M4: region, pressure, density, velocity and energy at x and t > 0; zero on a bound."""
    s = states
    region = classify_intervals(x, [("left", s["fan_left"] * t), ("fan", s["fan_right"] * t), ("contact", s["contact"] * t), ("shock", s["shock"] * t)], "right")
    fan_u = s["u_l"] + 2 / (gamma + 1) * (s["c_left"] + F.try_divide(x, t))
    fan = 1 - (gamma - 1) * (fan_u - s["u_l"]) / (2 * s["c_left"])
    pick = lambda left, in_fan, c, sh, right: F.when(region == "left", left).when(region == "fan", in_fan).when(region == "contact", c).when(region == "shock", sh).when(region == "right", right).otherwise(0.0)
    p = pick(s["p_l"], s["p_l"] * F.pow(fan, F.lit(2 * gamma / (gamma - 1))), s["p2"], s["p2"], s["p_r"])
    rho = pick(s["rho_l"], s["rho_l"] * F.pow(fan, F.lit(2 / (gamma - 1))), s["rho3"], s["rho2"], s["rho_r"])
    u = pick(s["u_l"], fan_u, s["u2"], s["u2"], s["u_r"])
    return {"region": region, "p": p, "rho": rho, "u": u, "energy": energy(p, rho, u, gamma)}


def checkerboard(i: Column, j: Column) -> Column:
    """M5: 1 where i and j have equal parity."""
    return F.when((i + j) % 2 == 0, 1.0).otherwise(0.0)


def ramp(i: Column, j: Column, ny: int) -> Column:
    """M6."""
    return (i * ny + j) / 100.0


def pressure(q: list[Column], gamma: float = GAMMA) -> Column:
    """M7: from rho, rho u, rho v, E; in one dimension from rho, rho u, E."""
    moved = q[1] * q[1] + q[2] * q[2] if len(q) == 4 else q[1] * q[1]
    return (gamma - 1) * (q[-1] - moved / (2 * q[0]))


def energy(p: Column, rho: Column, u: Column, gamma: float = GAMMA) -> Column:
    """M11."""
    return p / (gamma - 1) + rho * u * u / 2


def limit_ratio(num: Column, den: Column) -> Column:
    """M8: half of the ratio, at most 1/2; 0 where it is undefined, negative or above a million."""
    r = F.coalesce(F.try_divide(num, den), F.lit(0.0))
    return F.when(F.isnan(r) | (r > 1e6) | (r < 0), 0.0).otherwise(F.least(r, F.lit(1.0))) / 2


def limit_ratio_signed(num: Column, den: Column) -> Column:
    """M8 in one dimension: 0 unless both have the same strict sign."""
    return F.when(((num > 0) & (den > 0)) | ((num < 0) & (den < 0)), F.least(num / den, F.lit(1.0)) / 2).otherwise(0.0)


def flux(left: list[Column], right: list[Column], axis: int, gamma: float = GAMMA) -> list[Column]:
    """M9: flux of both sides added, along axis 1 (x) or 2 (y); three components in one dimension."""
    p_l, p_r, n = pressure(left, gamma), pressure(right, gamma), len(left)
    out = [left[axis] + right[axis]]
    for k in range(1, n - 1):
        if k == axis:
            out.append(left[k] * left[k] / left[0] + p_l + right[k] * right[k] / right[0] + p_r)
        else:
            out.append(left[1] * left[2] / left[0] + right[1] * right[2] / right[0])
    return [*out, (left[-1] + p_l) * left[axis] / left[0] + (right[-1] + p_r) * right[axis] / right[0]]


def spectral(left: list[Column], right: list[Column], axis: int, gamma: float = GAMMA) -> list[Column]:
    """Roe-averaged greatest wave speed times the jump; 0 where the speed is not a number."""
    a, b = F.sqrt(left[0]), F.sqrt(right[0])
    mean = [(a * l / left[0] + b * r / right[0]) * (1 / (a + b)) for l, r in zip(left[1:], right[1:])]
    rho = a * b
    p = pressure([rho, *(rho * m for m in mean)], gamma)
    speed = F.nanvl(F.sqrt(gamma * p / rho) + F.abs(mean[axis - 1]), F.lit(0.0))
    return [speed * (l - r) for l, r in zip(left, right)]
