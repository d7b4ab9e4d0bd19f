"""Logs of clicks and of outline edits against sequential models."""

import random

from folioframe.operators import selection as L
from folioframe.operators.outline_log import EDITS, apply_edits

OUTLINE = "doc_id string, node_id string, parent_id string, sib_index int, title string, source_id string, source_index int"


def click(state, order, kind, page):
    """The sequential rule for one click on (selected, anchor)."""
    chosen, anchor = state
    if kind == "single" or kind == "range" and (anchor not in order or page not in order):
        return {page}, page
    if kind == "toggle":
        return chosen ^ {page}, page
    if kind == "range":
        a, b = sorted((order.index(anchor), order.index(page)))
        return set(order[a : b + 1]), anchor
    if kind == "all":
        return set(order), order[0] if order else None
    return (set(), None) if kind == "clear" else state


def test_a_log_of_clicks_against_the_sequential_rule(spark):
    rng, pages, clicks, want = random.Random(4), [], [], {}
    for doc in range(150):
        order = [f"p{i}" for i in range(rng.randint(0 if doc % 10 == 0 else 1, 8))]
        pages += [(doc, p, i + 1) for i, p in enumerate(order)]
        state = set(), None
        for seq in range(rng.randint(1, 12)):
            kind = rng.choice(["single", "toggle", "toggle", "range", "range", "all", "clear", "odd"])
            page = rng.choice([*order, *order, "gone", "lost"])
            clicks.append((doc, seq, kind, page))
            state = click(state, order, kind, page)
        want[doc] = state
    rng.shuffle(clicks)
    log = spark.createDataFrame([*clicks, (1, None, "all", None), (2, 99, "single", None), (3, 99, None, "p0")], "doc_id long, seq long, kind string, page_id string")
    manifest = spark.createDataFrame(pages, "doc_id long, page_id string, position int")
    chosen, anchors = L.replay_clicks(manifest, log)
    got = {d: set() for d in want}
    for r in chosen.collect():
        assert r.page_id not in got[r.doc_id]
        got[r.doc_id].add(r.page_id)
    assert got == {d: s for d, (s, _) in want.items()}
    assert {r.doc_id: r.page_id for r in anchors.collect()} == {d: a for d, (_, a) in want.items() if a is not None}
    assert all(x.count() == 0 for x in L.replay_clicks(manifest, log.limit(0)))


class Nested:
    """Outlines as nested lists [id, title, children], edited by looking through all of them."""

    def __init__(self):
        self.roots = []

    def find(self, node, own=None, up=None):
        own = self.roots if own is None else own
        for i, n in enumerate(own):
            if n[0] == node:
                return own, i, up
            found = self.find(node, n[2], (own, i)) if n[2] else None
            if found:
                return found
        return None

    def flat(self, own=None, parent=None):
        for n in self.roots if own is None else own:
            yield n, parent
            yield from self.flat(n[2], n[0]) if n[2] else ()

    def edit(self, kind, node, at, parent, title):
        here = self.find(node)
        if kind.startswith("add"):
            target = self.find(parent if kind == "add_child" else at)
            if here or node is None:
                return
            if kind == "add_child" and target:
                target[0][target[1]][2].append([node, title, []])
            elif kind == "add_after" and at is None:
                self.roots.append([node, title, []])
            elif kind == "add_after" and target:
                target[0].insert(target[1] + 1, [node, title, []])
            return
        if not here:
            return
        own, i, up = here
        if kind == "rename" and title is not None:
            own[i][1] = title
        elif kind == "remove":
            del own[i]
        elif kind == "move_up" and i:
            own[i - 1 : i + 1] = own[i], own[i - 1]
        elif kind == "move_down" and i + 1 < len(own):
            own[i : i + 2] = own[i + 1], own[i]
        elif kind == "indent" and i:
            own[i - 1][2].append(own.pop(i))
        elif kind == "outdent" and up:
            up[0].insert(up[1] + 1, own.pop(i))
        elif kind == "move" and self.find(at):
            items = [(n[0], p) for n, p in self.flat()]
            titles = {n[0]: n[1] for n, _ in self.flat()}
            ids = [n for n, _ in items]
            parents = dict(items) | {node: parent if parent in titles else None}
            walk, seen = parents[node], set()
            while walk is not None and walk not in seen:
                seen.add(walk)
                if walk == node:
                    return
                walk = parents[walk]
            ids.insert(ids.index(at), ids.pop(ids.index(node))) if ids.index(node) > ids.index(at) else ids.insert(ids.index(at), ids.pop(ids.index(node)))
            made = {n: [n, titles[n], []] for n in ids}
            self.roots = []
            for n in ids:
                (self.roots if parents[n] is None else made[parents[n]][2]).append(made[n])


def test_a_log_of_outline_edits_against_nested_lists(spark):
    rng, rows, edits, want = random.Random(6), [], [], {}
    kinds = ["rename", "remove", "add_after", "add_after", "add_child", "add_child", "move_up", "move_down", "indent", "indent", "outdent", "move", "move", "odd"]
    for doc in map(str, range(60)):
        model, names = Nested(), [f"n{i}" for i in range(rng.randint(0, 9))]
        for n in names:
            model.edit("add_child" if rng.random() < 0.6 else "add_after", n, None, rng.choice(names), f"t{n}")
        for own, parent in [(model.roots, None), *((n[2], n[0]) for n, _ in model.flat())]:
            rows += [(doc, n[0], parent, i, n[1], "A", 1) for i, n in enumerate(own)]
        for seq in range(rng.randint(0, 25)):
            kind, some = rng.choice(kinds), lambda: rng.choice([*names, f"new{seq - 1}", f"new{seq - 3}", "gone", None])
            node = f"new{seq}" if kind.startswith("add") and rng.random() < 0.9 else some()
            edit = (kind, node, some(), some(), rng.choice([f"title {seq}", None]))
            edits.append((doc, seq, *edit, "A", 1))
            model.edit(*edit)
        want |= {(doc, n[0]): (p, n[1]) for n, p in model.flat()}
        want |= {(doc, p, "order"): [n[0] for n in own] for own, p in [(model.roots, None), *((n[2], n[0]) for n, _ in model.flat())] if own}
    rng.shuffle(edits)
    out = apply_edits(spark.createDataFrame(rows, OUTLINE), spark.createDataFrame([*edits, (None, 1, "remove", "n0", None, None, None, None, None), ("1", None, "remove", "n0", None, None, None, None, None)], EDITS)).collect()
    got = {(r.doc_id, r.node_id): (r.parent_id, r.title) for r in out}
    for r in sorted(out, key=lambda r: r.sib_index):
        got.setdefault((r.doc_id, r.parent_id, "order"), []).append(r.node_id)
    assert len(out) == len({(r.doc_id, r.node_id) for r in out}) and got == want
    empty = spark.createDataFrame([], OUTLINE)
    assert apply_edits(empty, spark.createDataFrame([], EDITS)).count() == 0
