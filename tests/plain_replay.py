"""A replay of edit logs on lists, one model at a time, to hold the tables' replay against."""

import math

STEP = 24.0


def whole(t):
    return abs(t - round(t)) < 1e-6


def retime(nodes, top):
    n = len(nodes)
    for i in range(n - 1 if top else 0):
        if nodes[i + 1]["t"] != 1:
            break
        nodes[i]["t"] = nodes[i]["th"] = 0.0
    exact = [whole(p["t"]) and not (i + 1 < n and whole(nodes[i + 1]["t"]) and round(nodes[i + 1]["t"]) == round(p["t"])) for i, p in enumerate(nodes)]
    c = [0.0]
    for a, b in zip(nodes, nodes[1:]):
        c.append(c[-1] + math.hypot(a["x"] - b["x"], a["y"] - b["y"]))
    old = [dict(p) for p in nodes]
    for i in range(n):
        before, after = [j for j in range(i) if exact[j]], [j for j in range(i + 1, n) if exact[j]]
        if not exact[i] and before and after:
            a, b = before[-1], after[0]
            share = 0.5 if c[b] - c[a] < 1e-6 else (c[i] - c[a]) / (c[b] - c[a])
            for k in ("t", "th"):
                nodes[i][k] = old[a][k] + share * (old[b][k] - old[a][k])


def nearest(model, parents, p, primaries=False):
    found = [
        (round((n["x"] - p[0]) ** 2 + (n["y"] - p[1]) ** 2, 6), r, i)
        for r, ns in model.items() for i, n in enumerate(ns) if n["t"] <= p[2] and (not primaries or parents[r] is None)
    ]
    return min(found)[1:] if found else None


def nearest_segment(model, p, most):
    found = []
    for r, ns in model.items():
        for i, (a, b) in enumerate(zip(ns, ns[1:])):
            ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], p[0] - a["x"], p[1] - a["y"]
            n2, dot = ux * ux + uy * uy, ux * vx + uy * vy
            if min(a["t"], b["t"]) <= p[2] and n2 and 0 <= dot <= n2 and (d := round((ux * vy - uy * vx) ** 2 / n2, 6)) < most * most:
                found.append((d, r, i))
    return min(found)[1:] if found else None


def node(p):
    return {"x": p[0], "y": p[1], "t": p[2], "th": math.floor(p[2]) * STEP}


def in_order(points):
    return len(points) >= 2 and all(a[2] <= b[2] <= a[2] + 1 for a, b in zip(points, points[1:]))


def fill_dates(nodes):
    out = nodes[:1]
    for a, b in zip(nodes, nodes[1:]):
        for day in range(math.floor(a["t"]) + 1, math.ceil(b["t"])):
            k = (day - a["t"]) / (b["t"] - a["t"])
            out.append({"x": a["x"] + k * (b["x"] - a["x"]), "y": a["y"] + k * (b["y"] - a["y"]), "t": float(day), "th": day * STEP})
        out.append(b)
    nodes[:] = out


def remove(model, parents, r, at):
    while at > 0 and not whole(model[r][at - 1]["t"]):
        at -= 1
    children = [c for c in parents if parents[c] == r]
    if len(children) > 1:
        for c in children:
            after = 0
            for i, n in enumerate(model[r][:-1]):
                if n["y"] < model[c][0]["y"]:
                    after = i + 1
            if after >= at:
                remove(model, parents, c, 0)
    if at:
        del model[r][at:]
        retime(model[r], parents[r] is None)
    else:
        del model[r], parents[r]


def switch(model, parents, p, q):
    a, b = nearest(model, parents, p), nearest(model, parents, q)
    if not a or not b or a[1] + 1 >= len(model[a[0]]) or b[1] + 1 >= len(model[b[0]]):
        return
    (r, i), (s, j) = a, b
    one, two = model[r], model[s]
    if math.floor(one[i]["t"]) > math.floor(two[j + 1]["t"]) or math.floor(two[j]["t"]) > math.floor(one[i + 1]["t"]):
        return
    floors = []
    for ns, k in ((one, i), (two, j)):
        for start, step in ((k, -1), (k + 1, 1)):
            at = start
            while 0 <= at < len(ns) and math.floor(ns[at]["t"]) == math.floor(ns[start]["t"]):
                floors.append(ns[at])
                at += step
    for n in floors:
        n["t"] = float(math.floor(n["t"]))
    if r == s:
        del one[min(i, j) + 1 : max(i, j) + 1]
    else:
        model[r], model[s] = one[: i + 1] + two[j + 1 :], two[: j + 1] + one[i + 1 :]
    for k in {r, s}:
        fill_dates(model[k])
        retime(model[k], parents[k] is None)


def apply(model, parents, action, points, precision=20.0):
    """Changes a model (lists of nodes by root) and the parents of its roots."""
    hit = nearest(model, parents, points[0])
    if action == "MOVEPOINT" and hit and len(points) > 1:
        model[hit[0]][hit[1]].update(x=points[1][0], y=points[1][1])
        retime(model[hit[0]], parents[hit[0]] is None)
    elif action == "CHANGETIME" and hit and len(points) > 1:
        model[hit[0]][hit[1]].update(t=points[1][2], th=points[1][2] * STEP)
        fill_dates(model[hit[0]])
        retime(model[hit[0]], parents[hit[0]] is None)
    elif action == "REMOVEPOINT" and hit:
        remove(model, parents, *hit)
    elif action == "ADDMIDDLE" and len(points) > 1 and (found := nearest_segment(model, points[0], precision)):
        r, i = found
        a, b = model[r][i], model[r][i + 1]
        span = b["t"] - a["t"]
        new = [{"x": p[0], "y": p[1], "t": a["t"] + span * ((p[2] - a["t"]) / span) if span else p[2], "th": a["th"] + (b["th"] - a["th"]) * ((p[2] - a["t"]) / span) if span else a["th"]} for p in points[1:]]
        model[r][i + 1 : i + 1] = new
        retime(model[r], parents[r] is None)
    elif action == "SWITCHPOINT" and len(points) > 1:
        switch(model, parents, *points[:2])
    elif action == "CREATEPRIMARY" and in_order(points):
        dates = [p[2] for p in points]
        new = list(dates)
        if dates[0] == dates[1] == 1:
            new[0] = 0.0
        i = 1
        while i < len(points) - 2 and dates[i] == dates[i + 1] == 1:
            new[i] = dates[0] - 1
            i += 1
        create(model, parents, [(*p[:2], t) for p, t in zip(points, new)], None)
    elif action == "CREATEBRANCH" and in_order(points) and (found := nearest(model, parents, points[0], True)):
        create(model, parents, points, found[0])
    elif action == "EXTENDBRANCH" and hit and in_order(points):
        ns = model[hit[0]]
        if hit[1] == len(ns) - 1 > 0 and ns[-1]["t"] == (0 if points[0][2] < 1 else points[0][2]):
            ns += [node(p) for p in points[1:]]
            retime(ns, parents[hit[0]] is None)
    elif action == "BACKEXTENDBRANCH" and hit and in_order(points[::-1]):
        ns = model[hit[0]]
        if hit[1] == 0 and (ns[0]["t"] or 1) == points[0][2]:
            ns[0]["th"] = math.floor(ns[0]["t"]) * STEP
            ns[:0] = [node(p) for p in points[:0:-1]]
            retime(ns, parents[hit[0]] is None)


def create(model, parents, points, parent):
    r = max(model) + 1
    model[r], parents[r] = [node(p) for p in points], parent
    retime(model[r], parent is None)
