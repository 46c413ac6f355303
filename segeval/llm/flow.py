"""Minimum-cost flow on a small graph of shards."""

from __future__ import annotations

import heapq


def min_cost_transfers(sizes: list[int], capacities: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Amounts from each old shard to each new one that fit the capacities at the least total cost.

    ``cost[i][j]`` is the cost of moving one unit from old shard ``i`` to new shard
    ``j``; costs are not negative. Successive shortest paths with potentials, on
    ``len(sizes) + len(capacities)`` nodes. The capacities must hold the sizes.
    """
    old, new = len(sizes), len(capacities)
    if sum(sizes) > sum(capacities):
        raise ValueError("the new shards are too small")
    flow = [[0] * new for _ in range(old)]
    left, room = list(sizes), list(capacities)
    potential = [0] * (old + new)
    while any(left):
        # Dijkstra from all old shards that have something left, over reduced costs.
        far = [float("inf")] * (old + new)
        came: list[int | None] = [None] * (old + new)
        queue = []
        for i in range(old):
            if left[i]:
                far[i] = 0
                heapq.heappush(queue, (0, i))
        while queue:
            d, v = heapq.heappop(queue)
            if d > far[v]:
                continue
            if v < old:
                steps = [(old + j, cost[v][j]) for j in range(new)]
            else:
                steps = [(i, -cost[i][v - old]) for i in range(old) if flow[i][v - old]]
            for w, c in steps:
                reduced = d + c + potential[v] - potential[w]
                if reduced < far[w]:
                    far[w], came[w] = reduced, v
                    heapq.heappush(queue, (reduced, w))
        end = min((j for j in range(new) if room[j]), key=lambda j: far[old + j] + potential[old + j])
        reach = far[old + end]
        potential = [p + min(f, reach) for p, f in zip(potential, far)]
        path = [old + end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end])
        for a, b in zip(path, path[1:]):
            if a >= old:
                amount = min(amount, flow[b][a - old])
        for a, b in zip(path, path[1:]):
            if a < old:
                flow[a][b - old] += amount
            else:
                flow[b][a - old] -= amount
        left[path[0]] -= amount
        room[end] -= amount
    return {(i, j): f for i, row in enumerate(flow) for j, f in enumerate(row) if f}
