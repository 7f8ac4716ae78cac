"""First-order optimisers over callables; each evaluation may be one distributed aggregation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass(frozen=True)
class Result:
    x: np.ndarray
    f_x: float
    iterations: int
    converged: bool


def wolfe_step(f: Objective, x: np.ndarray, fx: float, g: np.ndarray, direction: np.ndarray, first: float = 1.0, decrease: float = 1e-4, flat: float = 0.9, most: int = 50) -> tuple[float, float, np.ndarray]:
    """(t, f, gradient) at a step length that meets the strong Wolfe conditions.

    f must fall by ``decrease`` of what the slope at zero promises, and the slope
    must have shrunk to ``flat`` of its size. A length that is too long, or past
    the minimum, closes the bracket from above; one that still falls steeply
    moves its lower end. The next length is where a straight line through the
    slopes at both ends is zero, kept off the ends, or twice the length while
    the bracket is open. After ``most`` tries the best length that fell enough is taken.
    """
    start = float(g @ direction)
    low, low_slope, high, high_slope = 0.0, start, np.inf, np.nan
    best, t = (0.0, fx, g), first
    for _ in range(most):
        ft, gt = f(x + t * direction)
        slope = float(gt @ direction) if np.isfinite(ft) else np.nan
        if not np.isfinite(ft) or ft > fx + decrease * t * start:
            high, high_slope = t, np.nan
        else:
            if ft < best[1]:
                best = (t, ft, gt)
            if abs(slope) <= -flat * start:
                return t, ft, gt
            if slope < 0:
                low, low_slope = t, slope
            else:
                high, high_slope = t, slope
        if np.isinf(high):
            t = 2 * t
        else:
            zero = low_slope / (low_slope - high_slope) if np.isfinite(high_slope) else 0.5
            t = low + (high - low) * min(max(zero, 0.1), 0.9)
        if high - low <= 1e-16 * max(1.0, low):
            break
    return best


def gradient_descent(f: Objective, x0, max_iter: int = 10_000, g_rtol: float = float(np.sqrt(np.finfo(float).eps)), g_atol: float = float(np.finfo(float).eps)) -> Result:
    """Steepest descent; each search begins at twice the step before."""
    x = np.asarray(x0, float)
    fx, g = f(x)
    goal, t, it = max(np.linalg.norm(g) * g_rtol, g_atol), 1.0, 0
    while it < max_iter and np.linalg.norm(g) > goal:
        it += 1
        step, new, gn = wolfe_step(f, x, fx, g, -g, t)
        if step == 0:
            break
        x, fx, g, t = x - step * g, new, gn, 2 * step
    return Result(x, fx, it, bool(np.linalg.norm(g) <= goal))


def lbfgs(f: Objective, x0, m: int = 10, max_iter: int = 1000, g_tol: float = 1e-8, f_rtol: float = 1e-14) -> Result:
    """Limited-memory BFGS; the two-loop recursion over the last ``m`` steps."""
    x = np.asarray(x0, float)
    fx, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for it in range(max_iter):
        if np.abs(g).max(initial=0) <= g_tol:
            return Result(x, fx, it, True)
        q, left = g.copy(), []
        for s, y, r in reversed(past):
            left.append(r * (s @ q))
            q -= left[-1] * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(past, reversed(left), strict=True):
            q += s * (a - r * (y @ q))
        step = -q
        slope = float(g @ step)
        if slope >= 0:
            step, slope, past = -g, -float(g @ g), []
        t, new, gn = wolfe_step(f, x, fx, g, step)
        if t == 0:
            return Result(x, fx, it, False)
        s, y = t * step, gn - g
        if s @ y > 1e-300:
            past = [*past, (s, y, 1 / (s @ y))][-m:]
        flat = abs(fx - new) <= f_rtol * max(abs(fx), 1.0)
        x, fx, g = x + s, new, gn
        if flat:
            return Result(x, fx, it + 1, True)
    return Result(x, fx, max_iter, False)


def newton(f: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], x0, max_iter: int = 100, g_tol: float = 1e-8, f_rtol: float = 1e-14) -> Result:
    """Newton's method for a convex objective that gives its Hessian too; a step that does not lower it is halved."""
    x = np.asarray(x0, float)
    fx, g, h = f(x)
    for it in range(max_iter):
        if np.abs(g).max(initial=0) <= g_tol:
            return Result(x, fx, it, True)
        step, t = -np.linalg.lstsq(h, g, rcond=None)[0], 1.0
        new = f(x + step)
        while not new[0] <= fx + 1e-4 * t * float(g @ step) and t > 1e-10:
            t /= 2
            new = f(x + t * step)
        if not new[0] <= fx:
            return Result(x, fx, it, abs(new[0] - fx) <= f_rtol * max(abs(fx), 1.0))
        flat = abs(fx - new[0]) <= f_rtol * max(abs(fx), 1.0)
        x, (fx, g, h) = x + t * step, new
        if flat:
            return Result(x, fx, it + 1, True)
    return Result(x, fx, max_iter, False)
