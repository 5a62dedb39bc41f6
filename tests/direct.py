"""A plain dense fit on small data, written from the definition, for comparison.

Sequences of iterates are generated first; which one counts follows from their losses.
"""

from itertools import count

import numpy as np


def unit(v):
    return v / (np.linalg.norm(v) or 1.0)


def shrink(v, by):
    return np.where(np.abs(v) > by, v - np.copysign(by, v), 0.0)


def last_of(iterates, tol, cap):
    """The first iterate, from the second on, whose loss is 0 or near the one before; at most the (cap - 1)-th."""
    before = None
    for n, (vector, loss) in zip(count(1), iterates):
        near = before is not None and (loss == 0 or before != 0 and abs(1 - loss / before) <= tol)
        if near or (n > 1 and n == cap - 1):
            return vector
        before = loss


def subspace_steps(cov, x, bound):
    """Vectors of the other view's features, and the squared norm of the shrunk image each came from."""
    while True:
        image = shrink(x @ cov, bound)
        x = unit(cov @ image)
        yield x, image @ image


def one_pair(cov, rho, tol, cap):
    """cov has the other view's features as rows; the image of the last iterate, and the bound."""
    norms = np.sqrt((cov ** 2).sum(axis=0))
    best = np.flatnonzero(norms >= norms.max() * (1 - 1e-11))[0]
    bound = rho * norms[best]
    return last_of(subspace_steps(cov, cov[:, best] / norms[best], bound), tol, cap) @ cov, bound


def refit_steps(z, linear, squares):
    while True:
        t = linear + sum((m @ (m.T @ z) for m in squares), np.zeros_like(z))
        z = unit(t)
        yield z, -2 * np.linalg.norm(t)


def fit(xs, k, rhos, tol=1e-4, cap=1000, centered=True, full=False):
    """Loadings per component and view, and the ordered pairs' sigma per component."""
    xs = [x - x.mean(axis=0) * centered for x in xs]
    views = range(len(xs))
    pairs = [(j, i) for j in views for i in views if i != j]
    plain = {(j, i): xs[j].T @ xs[i] for j, i in pairs}
    components, sigmas = [], []

    def without(earlier):
        """The cross products less the given components."""
        return {(j, i): plain[j, i] - sum(
            (sigmas[q][j, i] * np.outer(components[q][j], components[q][i]) for q in earlier), np.zeros_like(plain[j, i]))
            for j, i in pairs}

    for c in range(k):
        deflated, start = without(range(c)), []
        for i in views:
            found = [one_pair(deflated[j, i][start[j] != 0] if j < i else deflated[j, i], rhos[i], tol, cap)
                     for j in views if j != i]
            start.append(unit(shrink(sum(image for image, _ in found), max(bound for _, bound in found))))
        used = deflated if full else without(range(c)[-1:])
        kept = {(j, i): m * (start[j] != 0)[:, None] * (start[i] != 0) for (j, i), m in used.items()}
        final = []
        for i in views:
            linear = sum((kept[i, j] @ final[j] for j in views if j < i), np.zeros(len(start[i])))
            final.append(last_of(refit_steps(start[i], linear, [kept[i, j] for j in views if j > i]), tol, cap))
        components.append(final)
        sigmas.append({(j, i): final[j] @ kept[j, i] @ final[i] for j, i in pairs})
    return components, sigmas
