"""Packages taken into a ledger, against sets and loops in plain Python."""

import random

from tallyloom.operators import ledger
from tallyloom.plans import shared


class Plain:
    """relations: name -> (machine, confirmed, {member: version}); alone: member -> (version, machine); apart: {pair: machine}."""

    def __init__(self, relations=(), alone=(), apart=()):
        self.relations, self.alone, self.apart = dict(relations), dict(alone), dict(apart)

    def groups(self):
        out = []
        for name, (machine, confirmed, ms) in self.relations.items():
            if confirmed:
                touched = [g for g in out if g[0] & set(ms)]
                out = [g for g in out if g not in touched]
                out.append((set(ms).union(*(g[0] for g in touched)), {machine}.union(*(g[1] for g in touched)), {name}.union(*(g[2] for g in touched))))
        return out

    def take_in(self, package, source):
        groups, said = self.groups(), {}
        drop, lone, freed, new = set(), set(), set(), []
        of = {m: g for g in groups for m in g[0]}
        for name, (_, confirmed, ms) in package.relations.items():
            if not confirmed:
                continue
            mine = [r for r in self.relations.values() if r[1]]
            reach = set(ms).union(*(of[m][0] for m in ms if m in of))
            closes = {p for p in self.apart if p <= reach and not any(p <= g[0] for g in groups)}
            units = [of[m] for m in ms if m in of] + [({m}, {self.alone[m][1]}, ()) for m in ms if m not in of and m in self.alone]
            units = [u for u in units if u[0] != set(ms)]
            if any(r[2] == ms for r in mine):
                verdict = "known"
            elif any(len(set(r[2]) & set(ms)) >= 2 for r in self.relations.values() if not r[1]):
                verdict = "confirm_vs_withdraw"
            elif any(self.apart[p] != source for p in closes):
                verdict = "group_vs_exclusion"
            elif any(u[1] != {source} for u in units):
                verdict = "different_groups"
            else:
                verdict = "adopted"
                new.append(("relation", name, (source, True, ms)))
                freed |= closes
                for u in units:
                    drop |= set(u[2])
                    if not u[2]:
                        lone |= u[0]
            said["relation", name] = verdict
        for m, (version, _) in package.alone.items():
            old, g = self.alone.get(m), of.get(m)
            if old and old[0] == version:
                verdict = "known"
            elif (old and old[1] != source) or (g and g[0] != {m} and g[1] != {source}):
                verdict = "different_groups"
            else:
                verdict = "adopted"
                lone.add(m)
                drop |= g[2] if g and g[0] != {m} else set()
                new.append(("alone", m, (version, source)))
            said["alone", str(m)] = verdict
        for p in package.apart:
            g = next((g for g in groups if p <= g[0]), None)
            verdict = "known" if p in self.apart else "group_vs_exclusion" if g and g[1] != {source} else "adopted"
            if verdict == "adopted":
                drop |= g[2] if g else set()
                new.append(("apart", p, source))
            said["apart", "|".join(map(str, sorted(p)))] = verdict
        after = Plain({k: r for k, r in self.relations.items() if k not in drop}, {m: a for m, a in self.alone.items() if m not in lone}, {p: s for p, s in self.apart.items() if p not in freed})
        for kind, key, row in new:
            (after.relations if kind == "relation" else getattr(after, kind))[key] = row
        return said, after


def frames(spark, plain):
    return ledger.Ledger(
        spark.createDataFrame([(k, m, c, i, v) for k, (m, c, ms) in plain.relations.items() for i, v in ms.items()], "relation string, machine string, confirmed boolean, member long, version string"),
        spark.createDataFrame([(m, v, s) for m, (v, s) in plain.alone.items()], "member long, version string, machine string"),
        spark.createDataFrame([(*sorted(p), s) for p, s in plain.apart.items()], "a long, b long, machine string"),
    )


def state(x):
    return sorted((r["relation"], r["machine"], r["confirmed"], r["member"], r["version"]) for r in x.relations.collect()), sorted(map(tuple, x.alone.collect())), sorted(map(tuple, x.apart.collect()))


def test_packages_equal_plain(spark):
    """Two hundred independent small cases at a time, four packages one after another; every verdict occurs."""
    rng, met = random.Random(11), set()

    def package(machine, turn):
        out = Plain()
        for case in range(200):
            base = case * 10
            for r in range(rng.randrange(0, 3)):
                ms = rng.sample(range(base, base + 6), rng.choice([2, 2, 3]))
                out.relations[f"{turn}.{machine}.{case}.{r}"] = (machine, rng.random() < 0.8, {m: rng.choice(["v", "v", "w"]) for m in ms})
            if rng.random() < 0.4:
                out.alone[base + rng.randrange(6)] = (rng.choice("vw"), machine)
            if rng.random() < 0.5:
                out.apart[frozenset(rng.sample(range(base, base + 6), 2))] = machine
        return out

    plain = package("m1", 0)
    now = frames(spark, plain)
    for turn, machine in enumerate(("m2", "m3", "m2", "m1"), 1):
        incoming = package(machine, turn)
        if turn == 3:  # some of what it said before, once more
            incoming.relations |= {k: r for k, r in plain.relations.items() if r[0] == "m2"}
        want, plain = plain.take_in(incoming, machine)
        said, now = ledger.take_in(now, frames(spark, incoming), machine, shared.cut)
        got = {(r["kind"], r["id"]): r["verdict"] for r in said.collect()}
        assert got == want
        met |= {(k, v) for (k, _), v in got.items()}
        assert state(now) == state(frames(spark, plain))
    assert {v for k, v in met if k == "relation"} == {"known", "confirm_vs_withdraw", "group_vs_exclusion", "different_groups", "adopted"}
    assert {v for k, v in met if k == "apart"} == {"known", "group_vs_exclusion", "adopted"} and ("alone", "different_groups") in met


def test_only_adopted_relations_are_joined_anew(spark, monkeypatch):
    """Groups after a package: those that stay as they were, beside those of the package's relations; a ledger after the last package is whole too."""
    joined, was = [], ledger.matching.components
    monkeypatch.setattr(ledger.matching, "components", lambda edges, cut: joined.append(edges.count()) or was(edges, cut))
    plain = Plain({f"r{i}": ("m1", True, {3 * i: "v", 3 * i + 1: "v"}) for i in range(50)})
    now = frames(spark, plain)
    for turn, machine in enumerate(("m2", "m2", "m1"), 1):
        ms = {0: "w", 1: "w", 2: "w"} if machine == "m1" else {1000: "v", 1001 + turn: "v"}
        incoming = Plain({f"{turn}": (machine, True, ms)})
        want, plain = plain.take_in(incoming, machine)
        said, now = ledger.take_in(now, frames(spark, incoming), machine, shared.cut, last=turn == 3)
        assert {(r["kind"], r["id"]): r["verdict"] for r in said.collect()} == want == {("relation", f"{turn}"): "adopted"}
        assert state(now) == state(frames(spark, plain))
    assert joined == [100, 2, 2]
