"""Chart parsing of short token strings, without and with error correction.

A grammar is text: one alternative a line, `Name = symbol symbol ...`; a symbol with a trailing `~` may be left out, `~~` is a
tilde, and what no line defines is a terminal. A token is one character and stands for a set of terminals.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from itertools import product

import numpy as np


class Grammar:
    def __init__(self, text: str):
        self.rules: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        for line in text.splitlines():
            if not line.strip():
                continue
            name, _, body = line.strip().partition(" = ")
            options = [(("~",),) if s == "~~" else ((s[:-1],), ()) if s.endswith("~") and len(s) > 1 else ((s,),) for s in body.split()]
            for choice in product(*options):
                flat = tuple(x for part in choice for x in part)
                if flat and flat not in self.rules[name] and flat != (name,):
                    self.rules[name].append(flat)
        self._unfork()
        self.first = self._first()
        self.opens: dict[tuple[str, frozenset[str]], list[tuple[str, ...]]] = {}
        self.bounds: dict[tuple[str, ...], _Bound] = {}

    def _unfork(self) -> None:
        """`X = X op X` becomes `X = X op Y`, Y being X's other alternatives: the same strings with one parse each, not all ways to pair them."""
        for name, bodies in list(self.rules.items()):
            forks = [b for b in bodies if len(b) > 1 and b[0] == b[-1] == name]
            if forks:
                one = f"{name}\0"
                self.rules[one] = [b for b in bodies if b not in forks]
                self.rules[name] = [(one,), *((*b[:-1], one) for b in forks)]

    def _first(self) -> dict[str, set[str]]:
        """Terminals that can begin each nonterminal."""
        first: dict[str, set[str]] = {name: set() for name in self.rules}
        changed = True
        while changed:
            changed = False
            for name, bodies in self.rules.items():
                before = len(first[name])
                for body in bodies:
                    first[name] |= first.get(body[0], {body[0]})
                changed |= len(first[name]) > before
        return first

    def _begin(self, name: str, here: frozenset[str]) -> list[tuple[str, ...]]:
        """Alternatives of a nonterminal that a token with these terminals can begin."""
        key = name, here
        got = self.opens.get(key)
        if got is None:
            got = self.opens[key] = [b for b in self.rules[name] if not here.isdisjoint(self.first.get(b[0], {b[0]}))]
        return got

    def starts_of(self, tokens: str, terminals: Callable[[str], frozenset[str]], starts: Iterable[str], stop: list[int] | None = None) -> frozenset[str]:
        """Those of the start symbols that derive the tokens exactly (Earley's recognizer; no rule is empty). The token
        that no parse can take, if there is one, is added to `stop`.

        Where a completed symbol is awaited by one item only, and as its last symbol, that item completes too, and so
        on; only the last of such a chain is entered (Leo's method), so that right recursion takes linear time.
        """
        n, rules = len(tokens), self.rules
        starts = [s for s in starts if s in rules]
        if not n:
            return frozenset()
        # waiting[k][X]: items (name, body, dot, origin) of set k whose next symbol is X
        waiting: list[dict[str, list]] = [defaultdict(list) for _ in range(n + 1)]
        done: set[str] = set()
        items: list = [(s, body, 0, 0) for s in starts for body in self._begin(s, terminals(tokens[0]))]
        predicted: set[str] = set(starts)
        tops: dict[tuple[str, int], tuple | None] = {}

        def top(name: str, origin: int) -> tuple | None:
            """The last item of the chain that a symbol completes; chains end at set 0, where every start symbol counts."""
            chain, found = [], None
            while origin:
                key = name, origin
                if key in tops:
                    found = tops[key] or found
                    break
                tops[key] = None
                wait = waiting[origin].get(name, ())
                if len(wait) != 1 or wait[0][2] + 1 != len(wait[0][1]):
                    break
                chain.append(key)
                name, body, dot, origin = wait[0]
                found = name, body, dot + 1, origin
            for key in chain:
                tops[key] = found
            return found

        for k in range(n + 1):
            seen, todo, nxt = set(items), items, []
            here = terminals(tokens[k]) if k < n else frozenset()
            while todo:
                name, body, dot, origin = item = todo.pop()
                if dot == len(body):
                    if origin == 0 and k == n and name in starts:
                        done.add(name)
                    last = top(name, origin)
                    if last:
                        if last not in seen:
                            seen.add(last)
                            todo.append(last)
                        continue
                    for a, b, d, o in waiting[origin].get(name, ()):
                        new = (a, b, d + 1, o)
                        if new not in seen:
                            seen.add(new)
                            todo.append(new)
                    continue
                symbol = body[dot]
                if symbol in rules:
                    waiting[k][symbol].append(item)
                    if symbol not in predicted:
                        predicted.add(symbol)
                        if k < n:
                            for b in self._begin(symbol, here):
                                new = (symbol, b, 0, k)
                                seen.add(new)
                                todo.append(new)
                elif symbol in here:
                    nxt.append((name, body, dot + 1, origin))
            if not nxt and k < n:
                if stop is not None:
                    stop.append(k)
                return frozenset()
            items, predicted = nxt, set()
        return frozenset(done)

    def repair(self, tokens: str, terminals: Callable[[str], frozenset[str]], starts: Iterable[str]) -> tuple[int, list[int]]:
        """(cost, places): the least number of tokens to drop, put in or exchange so that a start symbol derives the
        string, and where, for strings of any length and any cost.

        Items are worked off by the edits before and in them plus a bound from below on those after them, so the first
        whole parse is the best. Of items with the same sum the newest comes first. Where the bound says little, as of a
        text of another kind, a table of all spans is filled instead, which finds the same least number.
        """
        starts = sorted({s for s in starts if s in self.rules and self.first[s]})
        if not starts:
            raise ValueError("no start symbol derives anything")
        ahead = self.bounds.get(tuple(starts))
        if ahead is None:
            ahead = self.bounds[tuple(starts)] = _Bound(self, starts)
        n, rules, here = len(tokens), self.rules, [terminals(c) for c in tokens]
        before, after = ahead.over(here)
        goal = "\0goal"
        queue: list[list] = []  # by the sum: items (cost of all so far, cost since origin, item, places)
        done: set = set()
        reached: dict[tuple[str, int], int] = {}
        complete: dict[tuple[str, int], list] = defaultdict(list)
        waiting: dict[tuple[str, int], list] = defaultdict(list)

        def push(total: int, inside: int, name: str, body: tuple, dot: int, origin: int, at: int, places: tuple) -> None:
            left = (before[body[dot]] if dot < len(body) else after[name])[at]
            if left >= FAR:
                return
            while len(queue) <= total + left:
                queue.append([])
            queue[total + left].append((total, inside, (name, body, dot, origin, at), places))

        for s in starts:
            push(0, 0, goal, (s,), 0, 0, 0, ())
        level, left = 0, QUICK * (n + 1)
        while level < len(queue):
            if not queue[level]:
                level += 1
                continue
            total, inside, item, places = queue[level].pop()
            if item in done:
                continue
            done.add(item)
            left -= 1
            if left == 0:
                if ahead.table is None:
                    ahead.table = Table(self, starts)
                if ahead.table.room(n):
                    return ahead.table.repair(here)
            name, body, dot, origin, at = item
            if dot == len(body):
                if name == goal:
                    if at == n:
                        return total, sorted(set(places))
                    push(total + 1, inside + 1, name, body, dot, origin, at + 1, (*places, at))
                    continue
                if (name, origin, at) in done:
                    continue
                done.add((name, origin, at))
                complete[name, origin].append((inside, at, places))
                for t, i, p, (a, b, d, o, _) in waiting[name, origin]:
                    push(t + inside, i + inside, a, b, d + 1, o, at, p + places)
                continue
            symbol = body[dot]
            if symbol in rules:
                waiting[symbol, at].append((total, inside, places, item))
                for c, end, p in complete[symbol, at]:
                    push(total + c, inside + c, name, body, dot + 1, origin, end, places + p)
                if (symbol, at) not in reached:
                    reached[symbol, at] = total
                    for b in rules[symbol]:
                        push(total, 0, symbol, b, 0, at, at, ())
                continue
            if at < n and symbol in here[at]:
                push(total, inside, name, body, dot + 1, origin, at + 1, places)
            elif at < n:
                push(total + 1, inside + 1, name, body, dot + 1, origin, at + 1, (*places, at))
            push(total + 1, inside + 1, name, body, dot + 1, origin, at, (*places, at))
            if at < n:
                push(total + 1, inside + 1, name, body, dot, origin, at + 1, (*places, at))
        raise AssertionError("every string has a repair")


#: More edits than any string needs.
FAR = 1 << 28
#: Items a token that the search for a repair works off before the table takes over, and the bytes that a table may take;
#: of a string too long for one the search goes on. The least number is the same.
QUICK, TABLE_BYTES = 100, 400 << 20


class _Bound:
    """Bounds from below on the edits that the rest of a string needs, by which terminals may stand side by side.

    Edits that make every pair of neighbours one that some derivation has, and the last terminal one that may be last,
    are at most the edits that make the string derivable; they are counted for all ends of the string at once.
    """

    def __init__(self, grammar: Grammar, starts: list[str]):
        self.table: Table | None = None
        rules, first = grammar.rules, grammar.first
        whole = {s for s in rules if first[s]}
        bodies = {s: [b for b in rules[s] if all(x not in rules or x in whole for x in b)] for s in whole}
        used, todo = set(starts), list(starts)
        while todo:
            for b in bodies[todo.pop()]:
                for x in b:
                    if x in whole and x not in used:
                        used.add(x)
                        todo.append(x)
        self.terms = sorted({x for s in used for b in bodies[s] for x in b if x not in rules})
        self.index = {t: k for k, t in enumerate(self.terms)}
        self.firsts = {s: first[s] for s in used} | {t: {t} for t in self.terms}
        end, lasts, follow = "\0end", {s: set() for s in used}, {s: set() for s in used}
        for s in starts:
            follow[s].add(end)
        beside = {t: set() for t in self.terms}
        changed = True
        while changed:
            changed = False
            for s in used:
                for b in bodies[s]:
                    new = lasts.get(b[-1], {b[-1]}) - lasts[s]
                    lasts[s] |= new
                    changed |= bool(new)
                    for x, y in zip(b, (*b[1:], None)):
                        if x not in follow:
                            continue
                        new = (follow[s] if y is None else self.firsts[y]) - follow[x]
                        follow[x] |= new
                        changed |= bool(new)
        for s in used:
            for b in bodies[s]:
                for x, y in zip(b, b[1:]):
                    for t in lasts.get(x, {x}):
                        beside[t] |= self.firsts[y]
        for s in starts:
            for t in lasts[s]:
                beside[t].add(end)
        self.follow = follow
        # terminals put in between two, or before the end, at least: steps of a search in the graph of neighbours, less one
        size = len(self.terms)
        self.gap = np.full((size, size + 1), FAR, dtype=np.int32)
        at = {**self.index, end: size}
        self.index[end] = size
        for t in self.terms:
            row, ring, steps = self.gap[self.index[t]], {t}, 0
            known: set[str] = set()
            while ring:
                ring = {y for x in ring if x != end for y in beside[x]} - known
                for y in ring:
                    row[at[y]] = steps
                known |= ring
                steps += 1

    def over(self, here: list[frozenset[str]]) -> tuple[dict, dict]:
        """Two tables by symbol, each of the edits needed from every place on: before the symbol, and after a derivation of it."""
        n, size = len(here), len(self.terms)
        # least edits from a place on if a terminal is next, or nothing is
        nexts = np.empty((n + 1, size + 1), dtype=np.int32)
        passed = np.minimum(self.gap[:, size], FAR)
        nexts[n, :size], nexts[n, size] = passed + 1, 0
        exchange: dict[frozenset[str], np.ndarray] = {}
        for at in range(n - 1, -1, -1):
            cost = exchange.get(here[at])
            if cost is None:
                cost = exchange[here[at]] = np.ones(size, dtype=np.int32)
                cost[[self.index[t] for t in here[at] if t in self.index]] = 0
            take = np.append(cost + passed, n - at).astype(np.int32)
            passed = np.minimum((self.gap + take).min(axis=1), passed + 1)
            nexts[at, :size] = np.minimum(np.minimum(take[:size], passed + 1), nexts[at + 1, :size] + 1)
            nexts[at, size] = n - at
        return _Least(nexts, self.firsts, self.index), _Least(nexts, self.follow, self.index)


class _Least(dict):
    """Symbol to the least of its terminals' columns, as they are asked for."""

    def __init__(self, columns: np.ndarray, sets: dict[str, set[str]], index: dict[str, int]):
        self.columns, self.sets, self.index = columns, sets, index

    def __missing__(self, symbol: str) -> list[int]:
        if symbol == "\0goal":
            got = self.columns[:, -1].tolist()
        else:
            chosen = [self.index[t] for t in self.sets.get(symbol, ())]
            got = self.columns[:, chosen].min(axis=1).tolist() if chosen else [FAR] * len(self.columns)
        self[symbol] = got
        return got


class Table:
    """Least edits of all spans of a string and all symbols, spans of one length at once (after Aho and Peterson).

    Bodies are read from the left: a prefix of two or more symbols is a shorter prefix and a symbol side by side. A
    terminal takes one token of its span, or one in exchange, and the others are dropped; no span has cost FAR16.
    """

    FAR16 = 10_000

    def __init__(self, grammar: Grammar, starts: list[str]):
        least: dict[str, int] = {}
        changed = True
        while changed:  # fewest terminals of each symbol; what has none derives nothing
            changed = False
            for name, bodies in grammar.rules.items():
                for b in bodies:
                    if all(x in least or x not in grammar.rules for x in b):
                        size = sum(least.get(x, 1) for x in b)
                        if size < least.get(name, self.FAR16):
                            least[name], changed = size, True
        self.starts = [s for s in starts if s in least]
        used, todo = set(self.starts), list(self.starts)
        self.bodies: dict[str, list[tuple[str, ...]]] = {}
        while todo:
            name = todo.pop()
            self.bodies[name] = [b for b in grammar.rules[name] if all(x in least or x not in grammar.rules for x in b)]
            for x in {x for b in self.bodies[name] for x in b if x in least} - used:
                used.add(x)
                todo.append(x)
        names = sorted(used)
        terms = sorted({x for bs in self.bodies.values() for b in bs for x in b if x not in used})
        prefixes = sorted({b[:k] for bs in self.bodies.values() for b in bs for k in range(2, len(b) + 1)}, key=lambda b: (len(b), b))
        self.names, self.terms = len(names), terms
        self.at: dict = {x: k for k, x in enumerate([*names, *terms])}
        self.base = len(self.at)
        self.at |= {b: self.base + k for k, b in enumerate(prefixes)}
        self.prefixes = prefixes
        self.left = np.array([self.at[b[:-1] if len(b) > 2 else b[0]] for b in prefixes], dtype=np.int64)
        self.right = np.array([self.at[b[-1]] for b in prefixes], dtype=np.int64)
        self.least = np.array([least[x] for x in names] + [1] * len(terms) + [sum(least.get(x, 1) for x in b) for b in prefixes], dtype=np.int16)
        # a terminal at the side takes the outermost token or that is dropped; only two longer symbols meet at every place
        terminal = lambda v: (v >= self.names) & (v < self.base)
        self.ends = np.nonzero(terminal(self.right))[0]
        self.begins = np.nonzero(terminal(self.left) & ~terminal(self.right))[0]
        self.meets = np.nonzero(~terminal(self.left) & ~terminal(self.right))[0]
        sizes = np.array([len(b) for b in prefixes], dtype=np.int64)
        self.levels = [np.nonzero(sizes == k)[0] for k in range(2, int(sizes.max(initial=1)) + 1)]
        # a body over the span of one of its terminals or prefixes, the rest put in; and over that of one of its nonterminals
        edges: dict[tuple[int, int], int] = {}
        unit = np.full((len(names), len(names)), self.FAR16, dtype=np.int64)
        for name in names:
            a = self.at[name]
            for b in self.bodies[name]:
                whole = sum(least.get(x, 1) for x in b)
                for x in b:
                    rest = whole - least.get(x, 1)
                    if x in used:
                        unit[a, self.at[x]] = min(unit[a, self.at[x]], rest)
                    else:
                        edges[a, self.at[x]] = min(edges.get((a, self.at[x]), self.FAR16), rest)
                for k in range(2, len(b) + 1):
                    rest = sum(least.get(x, 1) for x in b[k:])
                    edges[a, self.at[b[:k]]] = min(edges.get((a, self.at[b[:k]]), self.FAR16), rest)
        np.fill_diagonal(unit, 0)
        for k in range(len(names)):
            unit = np.minimum(unit, unit[:, k : k + 1] + unit[k : k + 1, :])
        self.unit = np.minimum(unit, self.FAR16).astype(np.int16)
        order = sorted(edges)
        self.source = np.array([v for _, v in order], dtype=np.int64)
        self.rest = np.array([edges[e] for e in order], dtype=np.int16)
        heads = [a for a, _ in order]
        self.cuts = [k for k, a in enumerate(heads) if not k or heads[k - 1] != a]
        self.heads = np.array([heads[k] for k in self.cuts], dtype=np.int64)

    def room(self, n: int) -> bool:
        """Whether the table of n tokens, two bytes for half the pairs of places, keeps to its bytes."""
        return n * n * (len(self.least) + 2 * len(self.meets)) <= TABLE_BYTES

    def fill(self, here: list[frozenset[str]]) -> list[np.ndarray]:
        """By length: least edits of every symbol and prefix (rows) over every span of that length (columns, by start)."""
        n, far, base, least = len(here), np.int16(self.FAR16), self.base, self.least[:, None]
        own = np.array([[t in h for h in here] for t in self.terms], dtype=bool).reshape(len(self.terms), n)
        exchange, rest, unit = (~own).astype(np.int16), self.rest[:, None], self.unit[:, :, None]
        e, b, meets = self.ends, self.begins, self.meets
        costs, lefts, rights, held = [np.tile(least, (1, n + 1))], [least], [least], own
        for m in range(1, n + 1):
            spans = n - m + 1
            held = own if m == 1 else held[:, :spans] | own[:, m - 1 :]
            table = np.empty((len(least), spans), dtype=np.int16)
            table[self.names : base] = m - held
            shorter = costs[m - 1][:, :spans]
            table[base + e] = np.minimum(shorter[base + e] + 1, shorter[self.left[e]] + exchange[self.right[e] - self.names, m - 1 :])
            shorter = costs[m - 1][:, 1:]
            table[base + b] = np.minimum(shorter[base + b] + 1, shorter[self.right[b]] + exchange[self.left[b] - self.names, :spans])
            inner = np.full((len(meets), spans), far, dtype=np.int16)
            both = np.empty_like(inner)
            for k in range(1, m):
                np.minimum(inner, np.add(lefts[k][:, :spans], rights[m - k][:, k : k + spans], out=both), out=inner)
            table[base + meets] = inner
            first = np.full((self.names, spans), far, dtype=np.int16)
            first[self.heads] = np.minimum.reduceat(table[self.source] + rest, self.cuts, axis=0)
            table[: self.names] = np.minimum((first + unit).min(axis=1), far)
            for level in self.levels:
                l, r = self.left[level], self.right[level]
                edge = np.minimum(table[l] + least[r], table[r] + least[l])
                table[base + level] = np.minimum(table[base + level], edge)
            costs.append(table)
            lefts.append(table[self.left[meets]])
            rights.append(table[self.right[meets]])
        return costs

    def repair(self, here: list[frozenset[str]]) -> tuple[int, list[int]]:
        """As Grammar.repair."""
        costs, n = self.fill(here), len(here)
        cost = lambda v, i, j: int(costs[j - i][v, i])
        start = min(self.starts, key=lambda s: cost(self.at[s], 0, n))
        places, todo = set(), [(start, 0, n)]
        while todo:
            symbol, i, j = todo.pop()
            if i == j:
                places.add(i)
                continue
            want = cost(self.at[symbol], i, j)
            if not want:
                continue
            if isinstance(symbol, tuple):
                before, last = (symbol[:-1] if len(symbol) > 2 else symbol[0]), symbol[-1]
                a, b = self.at[before], self.at[last]
                k = next(k for k in range(i, j + 1) if cost(a, i, k) + cost(b, k, j) == want)
                todo += [(before, i, k), (last, k, j)]
            elif symbol in self.bodies:
                # along bodies of one symbol, which may lead in a ring, to one that divides the span or a terminal
                ring, known, found = [symbol], {symbol}, None
                while found is None:
                    for b in self.bodies[ring.pop(0)]:
                        part = b if len(b) > 1 else b[0]
                        if cost(self.at[part], i, j) == want:
                            if len(b) > 1 or part not in self.bodies:
                                found = part
                                break
                            if part not in known:
                                known.add(part)
                                ring.append(part)
                todo.append((found, i, j))
            else:
                kept = next((k for k in range(i, j) if symbol in here[k]), None)
                places |= set(range(i, j)) - {kept}
        return cost(self.at[start], 0, n), sorted(places)
