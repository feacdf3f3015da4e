"""Quotas of strata, one unit at a time."""


def settled(sizes, total, floor=5):
    n = sum(sizes.values())
    own = {s: min(k, max(floor, round(total * k / n))) for s, k in sizes.items()}
    for step in (-1, 1):
        for s in sorted(own, key=lambda s: (sizes[s] * step, s)):
            while (total - sum(own.values())) * step > 0 and min(floor, sizes[s]) <= own[s] + step <= sizes[s]:
                own[s] += step
    return own
