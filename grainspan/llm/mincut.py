"""Minimum cuts of graphs with two terminals."""

from __future__ import annotations


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut (of several, the one with fewest such nodes).

    ``source[i]`` and ``sink[i]`` are node i's terminal capacities, ``edges`` undirected capacities. What flows
    straight from source to sink through a node is taken off first. The rest goes by blocking flows: each phase finds, in
    one search from all nodes with supply at once, how far every node is from them, stops at the first distance with
    demand, and sends what it can along shortest paths; an edge that leads nowhere is not tried again in its phase. The
    phases end when no demand can be reached, so a phase costs one pass and their number is that of different path lengths.
    """
    n = len(source)
    spare = [a - b for a, b in zip(source, sink, strict=True)]
    to: list[list[int]] = [[] for _ in range(n)]
    head, room = [], []
    for a, b, c in edges:
        to[a].append(len(head))
        to[b].append(len(head) + 1)
        head += [b, a]
        room += [c, c]
    eps = 1e-12
    while True:
        level = [-1] * n
        wave = [i for i in range(n) if spare[i] > eps]
        for i in wave:
            level[i] = 0
        starts, depth, found = wave, 0, False
        while wave and not found:
            depth += 1
            new = []
            for u in wave:
                for e in to[u]:
                    v = head[e]
                    if level[v] < 0 and room[e] > eps:
                        level[v] = depth
                        new.append(v)
                        found = found or spare[v] < -eps
            wave = new
        if not found:
            return [x >= 0 for x in level]
        tried = [0] * n
        for s in starts:
            path: list[int] = []
            u = s
            while spare[s] > eps:
                if spare[u] < -eps:
                    flow = min(spare[s], -spare[u], min(room[e] for e in path))
                    spare[s] -= flow
                    spare[u] += flow
                    full = len(path)
                    for k, e in enumerate(path):
                        room[e] -= flow
                        room[e ^ 1] += flow
                        if room[e] <= eps and k < full:
                            full = k
                    # On from the node before the first full edge, or from here if its demand is met.
                    if full < len(path):
                        u = head[path[full] ^ 1]
                        del path[full:]
                    continue
                if level[u] < depth:
                    k, out = tried[u], to[u]
                    while k < len(out) and not (level[head[out[k]]] == level[u] + 1 and room[out[k]] > eps):
                        k += 1
                    tried[u] = k
                    if k < len(out):
                        path.append(out[k])
                        u = head[out[k]]
                        continue
                if not path:
                    break
                u = head[path.pop() ^ 1]
                tried[u] += 1


def cut_value(source: list[float], sink: list[float], edges: list[tuple[int, int, float]], side: list[bool]) -> float:
    """What a labelling costs."""
    return sum(t if s else f for f, t, s in zip(source, sink, side, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])
