"""DuckDB SQL for the registered queries. Atoms and bonds come from tables of the fragments, not from SMILES, so that agreement tests the reader too."""

from __future__ import annotations

from ringwork.plans.queries import ATOM_KEYS, PATH_KEYS
from ringwork.sources.readers import FRAGMENTS, METALS

# Atoms (fragment, place, atomic number, charge, mass difference, aromatic, hydrogens in brackets, ring) and bonds (fragment, a, b, kind, ring)
# of the fragments; 16 and 17 are what follows the others: an acid, joined, and an ion, apart. Last: atoms of each, and the atom that the next is joined to.
_ATOMS = """
(0,0,6,0,0,0,NULL,0),(1,0,6,0,0,0,NULL,0),(1,1,6,0,0,0,NULL,0),(2,0,7,0,0,0,NULL,0),(3,0,8,0,0,0,NULL,0),(4,0,6,0,0,0,NULL,0),(4,1,8,0,0,0,NULL,0),
(5,0,6,0,0,0,NULL,0),(5,1,8,0,0,0,NULL,0),(5,2,7,0,0,0,NULL,0),
(6,0,6,0,0,1,NULL,1),(6,1,6,0,0,1,NULL,1),(6,2,6,0,0,1,NULL,1),(6,3,6,0,0,1,NULL,1),(6,4,6,0,0,1,NULL,1),(6,5,6,0,0,1,NULL,1),
(7,0,6,0,0,0,NULL,1),(7,1,6,0,0,0,NULL,1),(7,2,6,0,0,0,NULL,1),(7,3,6,0,0,0,NULL,1),(7,4,6,0,0,0,NULL,1),(7,5,6,0,0,0,NULL,1),
(8,0,6,0,0,1,NULL,1),(8,1,6,0,0,1,NULL,1),(8,2,6,0,0,1,NULL,1),(8,3,7,0,0,1,NULL,1),(8,4,6,0,0,1,NULL,1),(8,5,6,0,0,1,NULL,1),
(9,0,6,0,0,0,NULL,0),(9,1,9,0,0,0,NULL,0),(10,0,6,0,0,0,NULL,0),(10,1,17,0,0,0,NULL,0),(11,0,16,0,0,0,NULL,0),(11,1,8,0,0,0,NULL,0),(11,2,8,0,0,0,NULL,0),
(12,0,6,0,0,0,NULL,0),(12,1,6,0,0,0,NULL,0),(13,0,6,0,0,0,NULL,0),(13,1,6,0,0,0,NULL,0),(14,0,15,0,0,0,NULL,0),(14,1,8,0,0,0,NULL,0),(14,2,8,0,0,0,NULL,0),
(15,0,6,0,1,0,2,0),(16,0,8,0,0,0,NULL,0),(16,1,17,0,0,0,NULL,0),(16,2,8,0,0,0,NULL,0),(16,3,8,0,0,0,NULL,0),(17,0,11,1,0,0,0,0)
"""
_BONDS = """
(1,0,1,'single',0),(4,0,1,'double',0),(5,0,1,'double',0),(5,0,2,'single',0),
(6,0,1,'aromatic',1),(6,1,2,'aromatic',1),(6,2,3,'aromatic',1),(6,3,4,'aromatic',1),(6,4,5,'aromatic',1),(6,0,5,'aromatic',1),
(7,0,1,'single',1),(7,1,2,'single',1),(7,2,3,'single',1),(7,3,4,'single',1),(7,4,5,'single',1),(7,0,5,'single',1),
(8,0,1,'aromatic',1),(8,1,2,'aromatic',1),(8,2,3,'aromatic',1),(8,3,4,'aromatic',1),(8,4,5,'aromatic',1),(8,0,5,'aromatic',1),
(9,0,1,'single',0),(10,0,1,'single',0),(11,0,1,'double',0),(11,0,2,'double',0),(12,0,1,'triple',0),(13,0,1,'double',0),(14,0,1,'double',0),(14,0,2,'single',0),
(16,0,1,'single',0),(16,1,2,'double',0),(16,1,3,'double',0)
"""
_ENDS = "(0,1,0),(1,2,1),(2,1,0),(3,1,0),(4,2,0),(5,3,2),(6,6,5),(7,6,5),(8,6,5),(9,2,0),(10,2,0),(11,3,0),(12,2,1),(13,2,1),(14,3,0),(15,1,0),(16,4,3),(17,1,0)"


def fold_hash(values: str) -> str:
    """The 32-bit hash of a list, whose first value is the seed."""
    return f"list_reduce({values}, lambda s, v: xor(s, (v + 2654435769 + (s << 6) + (s >> 2)) & 4294967295))"


BASE = f"""
WITH RECURSIVE fa(frag, idx, z, charge, delta, arom, hb, ring) AS (VALUES {_ATOMS}),
fb(frag, a, b, kind, ring) AS (VALUES {_BONDS}),
fo(frag, n, outer_atom) AS (VALUES {_ENDS}),
pt AS (SELECT p_partkey AS mol_id, CAST(p_size AS BIGINT) AS sz FROM part),
pc AS (SELECT mol_id, i AS k, ((mol_id >> CAST(4 * i AS INTEGER)) + sz * (2 * i + 1)) % 16 AS frag, 1 AS joined FROM pt, range(0, 4) AS r(i) WHERE i <= sz % 4
  UNION ALL SELECT mol_id, 9, 17, 0 FROM pt WHERE sz % 10 = 0
  UNION ALL SELECT mol_id, 9, 16, 1 FROM pt WHERE sz % 11 = 0 AND sz % 10 <> 0),
po AS MATERIALIZED (SELECT mol_id, k, pc.frag, joined, n, coalesce(sum(n) OVER w, 0) - n AS off, outer_atom FROM pc JOIN fo USING (frag) WINDOW w AS (PARTITION BY mol_id ORDER BY k)),
bonds AS MATERIALIZED (
  SELECT mol_id, CAST(off + a AS INTEGER) AS a, CAST(off + b AS INTEGER) AS b, kind, ring = 1 AS in_ring FROM po JOIN fb USING (frag)
  UNION ALL SELECT mol_id, CAST(before AS INTEGER), CAST(off AS INTEGER), 'single', false FROM (SELECT mol_id, joined, off, lag(off + outer_atom) OVER (PARTITION BY mol_id ORDER BY k) AS before FROM po) WHERE joined = 1 AND before IS NOT NULL),
ord AS (SELECT *, CASE kind WHEN 'double' THEN 2 WHEN 'triple' THEN 3 ELSE 1 END AS o FROM bonds),
dir AS MATERIALIZED (SELECT mol_id, a AS atom, b AS other, a * 1000 + b AS edge, kind, o FROM ord UNION ALL SELECT mol_id, b, a, a * 1000 + b, kind, o FROM ord),
deg AS (SELECT mol_id, atom, count(*) AS degree, sum(o) AS orders, sum(o - 1) AS unsat, bool_or(o = 1) AS has_single FROM dir GROUP BY ALL),
atoms AS MATERIALIZED (
  SELECT p.mol_id, CAST(off + idx AS INTEGER) AS atom, z, charge, delta, arom = 1 AS arom, ring = 1 AS in_ring, CASE WHEN p.frag = 17 THEN 1 ELSE 0 END AS comp,
    CAST(coalesce(degree, 0) AS BIGINT) AS degree, CAST(coalesce(orders, 0) AS BIGINT) AS orders, CAST(coalesce(unsat, 0) AS BIGINT) AS unsat, coalesce(has_single, false) AS has_single,
    CAST(CASE WHEN hb IS NOT NULL THEN hb WHEN arom = 1 THEN greatest(0, (CASE z WHEN 6 THEN 4 ELSE 3 END) - orders - 1)
      ELSE coalesce(list_min(list_filter(CASE z WHEN 6 THEN [4] WHEN 7 THEN [3, 5] WHEN 8 THEN [2] WHEN 15 THEN [3, 5] WHEN 16 THEN [2, 4, 6] ELSE [1] END, lambda v: v >= coalesce(orders, 0))), coalesce(orders, 0)) - coalesce(orders, 0) END AS BIGINT) AS h
  FROM po p JOIN fa f ON f.frag = p.frag LEFT JOIN deg d ON d.mol_id = p.mol_id AND d.atom = p.off + f.idx),
dox AS (SELECT d.mol_id, d.atom, sum(CASE WHEN d.o >= 2 THEN 1 ELSE 0 END) AS c FROM dir d JOIN atoms x ON x.mol_id = d.mol_id AND x.atom = d.atom AND x.z IN (17, 35, 53)
  JOIN atoms y ON y.mol_id = d.mol_id AND y.atom = d.other AND y.z = 8 GROUP BY ALL HAVING bool_or(d.o = 1) AND bool_or(d.o >= 2)),
oxo AS (SELECT DISTINCT d.mol_id, d.atom FROM dir d JOIN dox x ON x.mol_id = d.mol_id AND x.atom = d.other JOIN atoms a ON a.mol_id = d.mol_id AND a.atom = d.atom WHERE a.z = 8 AND d.o >= 2),
inv AS MATERIALIZED (SELECT a.mol_id, a.atom, a.in_ring, [CAST(0 AS BIGINT), a.z, a.degree + a.h, a.h, (CASE WHEN x.c IS NOT NULL THEN x.c WHEN o.atom IS NOT NULL THEN -1 ELSE a.charge END) & 4294967295, a.delta & 4294967295] AS parts
  FROM atoms a LEFT JOIN dox x USING (mol_id, atom) LEFT JOIN oxo o USING (mol_id, atom)),
codes AS MATERIALIZED (SELECT a.mol_id, a.atom, a.degree, coalesce(list_position([5, 6, 7, 8, 9, 14, 15, 16, 17, 33, 34, 35, 51, 52, 53], a.z) - 1, 15) AS kind,
  CASE WHEN a.arom THEN 1 WHEN o.atom IS NOT NULL OR a.unsat = 0 OR a.z = 11 THEN 0 WHEN a.z = 17 THEN CASE WHEN a.degree >= 2 THEN 0 ELSE a.unsat END
    WHEN a.z = 15 THEN CASE WHEN a.degree <= 2 AND NOT (a.degree = 2 AND a.h = 2) OR a.degree = 3 AND a.h = 0 THEN a.unsat ELSE 0 END
    WHEN a.z = 16 THEN CASE WHEN a.degree = 2 THEN a.unsat WHEN a.unsat = 1 THEN CASE WHEN NOT a.has_single OR a.degree = 4 THEN 1 ELSE 0 END WHEN a.has_single THEN 0 ELSE a.unsat END
    ELSE a.unsat END AS pi FROM atoms a LEFT JOIN oxo o USING (mol_id, atom))
"""


def code(subtract: int) -> str:
    return f"CAST(greatest(degree - {subtract}, 0) % 7 + (pi % 3) * 8 + kind * 32 AS BIGINT)"


def invariant(ring: bool) -> str:
    return fold_hash("CASE WHEN in_ring THEN parts || [CAST(1 AS BIGINT)] ELSE parts END" if ring else "parts")


def bond_value(types: bool) -> str:
    """The invariant of the bond of a row with kind, o, mol_id, atom, other."""
    if not types:
        return "CAST(1 AS BIGINT)"
    center = "EXISTS (SELECT 1 FROM dox x WHERE x.mol_id = d.mol_id AND x.atom IN (d.atom, d.other))"
    return f"CAST(CASE WHEN {center} AND ((za.z = 8 AND zb.z IN (17, 35, 53)) OR (zb.z = 8 AND za.z IN (17, 35, 53))) THEN 1 WHEN d.kind = 'aromatic' THEN 12 ELSE d.o END AS BIGINT)"


ENDS = "JOIN atoms za ON za.mol_id = d.mol_id AND za.atom = d.atom JOIN atoms zb ON zb.mol_id = d.mol_id AND zb.atom = d.other"


def emitted(radius: int, types: bool = True, ring: bool = True, base: str = BASE) -> str:
    """BASE and more, up to em(mol_id, layer, hash): what each layer emits."""
    sql = base + f""",
adj AS MATERIALIZED (SELECT d.mol_id, d.atom, d.other, d.edge, {bond_value(types)} AS binv FROM dir d {ENDS}),
s0 AS MATERIALIZED (SELECT mol_id, atom, CAST({invariant(ring)} AS BIGINT) AS inv, CAST([] AS BIGINT[]) AS nbh, EXISTS (SELECT 1 FROM dir d WHERE d.mol_id = inv.mol_id AND d.atom = inv.atom) AS live FROM inv),
seen0 AS (SELECT mol_id, nbh FROM s0 WHERE false)"""
    for k in range(radius):
        sql += f""",
c{k} AS MATERIALIZED (SELECT s.mol_id, s.atom, list_sort(list_distinct(flatten(list(list_append(n.nbh, a.edge))) || any_value(s.nbh))) AS nbh,
  {fold_hash(f"[CAST({k} AS BIGINT), any_value(s.inv)] || list({fold_hash('[CAST(0 AS BIGINT), a.binv, n.inv]')} ORDER BY a.binv, n.inv)")} AS inv
  FROM s{k} s JOIN adj a USING (mol_id, atom) JOIN s{k} n ON n.mol_id = a.mol_id AND n.atom = a.other WHERE s.live GROUP BY s.mol_id, s.atom),
w{k} AS MATERIALIZED (SELECT mol_id, atom, nbh, inv FROM (SELECT *, row_number() OVER (PARTITION BY mol_id, nbh ORDER BY inv, atom) AS r FROM c{k}) c WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM seen{k} x WHERE x.mol_id = c.mol_id AND x.nbh = c.nbh)),
seen{k + 1} AS MATERIALIZED (SELECT mol_id, nbh FROM seen{k} UNION ALL SELECT mol_id, nbh FROM w{k}),
s{k + 1} AS MATERIALIZED (SELECT s.mol_id, s.atom, coalesce(c.inv, 0) AS inv, coalesce(c.nbh, s.nbh) AS nbh, w.atom IS NOT NULL AS live FROM s{k} s LEFT JOIN c{k} c USING (mol_id, atom) LEFT JOIN w{k} w USING (mol_id, atom))"""
    parts = ["SELECT mol_id, 0 AS layer, inv AS hash FROM s0", *(f"SELECT mol_id, {k + 1}, inv FROM w{k}" for k in range(radius))]
    return sql + ",\nem AS (" + " UNION ALL ".join(parts) + ")"


def ecfp_bits(radius: int, size: int, types: bool = True, ring: bool = True) -> str:
    return emitted(radius, types, ring) + f"\nSELECT DISTINCT mol_id, CAST(hash % {size} AS INTEGER) AS bit FROM em"


def ecfp_counts(size: int, base: str = BASE) -> str:
    return emitted(2, base=base) + f"\nSELECT mol_id, CAST(hash % {size} AS INTEGER) AS bit, count(*) AS cnt FROM em GROUP BY ALL"


LAYERED = emitted(2) + "\nSELECT mol_id, CAST(layer AS INTEGER) AS layer, CAST(hash % 2048 AS INTEGER) AS bit, count(*) AS cnt FROM em GROUP BY ALL"

DISTANCES = BASE + """,
bfs AS (SELECT mol_id, atom AS a, atom AS b, 0 AS d FROM atoms UNION SELECT r.mol_id, r.a, x.other, r.d + 1 FROM bfs r JOIN dir x ON x.mol_id = r.mol_id AND x.atom = r.b WHERE r.d < 30),
dist AS MATERIALIZED (SELECT mol_id, a, b, CAST(min(d) AS INTEGER) AS d FROM bfs GROUP BY mol_id, a, b)
"""


def bits_of(hashes: str, simulate: bool) -> str:
    """Bits of a query of (mol_id, h), with or without simulated counts, at 2048 bits."""
    if not simulate:
        return f"SELECT DISTINCT mol_id, CAST(h % 2048 AS INTEGER) AS bit FROM ({hashes})"
    return f"SELECT mol_id, CAST(bucket * 4 + k AS INTEGER) AS bit FROM (SELECT mol_id, h % 512 AS bucket, count(*) AS n FROM ({hashes}) GROUP BY ALL), range(0, 4) AS r(k) WHERE n >= CAST(pow(2, k) AS BIGINT)"


def pair_bits(nearest: int = 1, farthest: int = 30, simulate: bool = True, codes: str | None = None) -> str:
    h = fold_hash("[CAST(0 AS BIGINT), least(x.c, y.c), CAST(d AS BIGINT), greatest(x.c, y.c)]")
    side = codes or f"(SELECT mol_id, atom, {code(0)} AS c FROM codes)"
    hashes = f"SELECT t.mol_id, {h} AS h FROM dist t JOIN {side} x ON x.mol_id = t.mol_id AND x.atom = t.a JOIN {side} y ON y.mol_id = t.mol_id AND y.atom = t.b WHERE t.a < t.b AND t.d BETWEEN {nearest} AND {farthest}"
    return DISTANCES + bits_of(hashes, simulate)


def paths(k: int, base: str) -> str:
    """base and pth(mol_id, p): paths of k atoms, one way around each; the fragments have no rings that such a path can close."""
    joins = "".join(f" JOIN dir d{j} ON d{j}.mol_id = d0.mol_id AND d{j}.atom = d{j - 1}.other AND d{j}.edge NOT IN ({', '.join(f'd{i}.edge' for i in range(j))})" for j in range(1, k - 1))
    atoms = "[d0.atom, " + ", ".join(f"d{j}.other" for j in range(k - 1)) + "]"
    return base + f",\npth AS (SELECT mol_id, p FROM (SELECT d0.mol_id, {atoms} AS p FROM dir d0{joins}) WHERE p <= list_reverse(p))\n"


def torsion_bits(k: int = 4, simulate: bool = True, shortest: bool = False) -> str:
    sides = "".join(f" JOIN codes c{j} ON c{j}.mol_id = t.mol_id AND c{j}.atom = t.p[{j + 1}]" for j in range(k))

    def value(j: int) -> str:
        return code(1 if j in (0, k - 1) else 2).replace("degree", f"c{j}.degree").replace("pi %", f"c{j}.pi %").replace("kind *", f"c{j}.kind *")

    inner = f"SELECT t.mol_id, [{', '.join(map(value, range(k)))}] AS c FROM pth t{sides}"
    if shortest:
        inner += f" JOIN dist s ON s.mol_id = t.mol_id AND s.a = t.p[1] AND s.b = t.p[{k}] AND s.d = {k - 1}"
    hashes = f"SELECT mol_id, {fold_hash('[CAST(0 AS BIGINT)] || least(c, list_reverse(c))')} AS h FROM ({inner})"
    return paths(k, DISTANCES if shortest else BASE) + bits_of(hashes, simulate)


def atom_key_tests() -> dict[int, tuple[str, int]]:
    """Condition on an atom, and the count that must be exceeded, of the keys of single atoms."""
    return {
        20: ("z = 14", 0), 27: ("z = 53", 0), 29: ("z = 15", 0), 35: ("z IN (3, 11, 19, 37, 55, 87)", 0), 42: ("z = 9", 0), 44: ("z NOT IN (1, 6, 7, 8, 9, 14, 15, 16, 17, 35, 53)", 0),
        46: ("z = 35", 0), 49: ("charge <> 0", 0), 57: ("z = 8 AND in_ring", 0), 84: ("z = 7 AND h = 2 AND NOT arom", 0), 88: ("z = 16", 0), 103: ("z = 17", 0), 121: ("z = 7 AND in_ring", 0),
        131: ("z NOT IN (1, 6) AND h > 0", 1), 134: ("z IN (9, 17, 35, 53)", 0), 139: ("z = 8 AND h > 0", 0), 140: ("z = 8", 3), 141: ("z = 6 AND h = 3 AND NOT arom", 2), 142: ("z = 7", 1), 146: ("z = 8", 2),
        149: ("z = 6 AND h IN (3, 4) AND NOT arom", 1), 151: ("z = 7 AND h > 0", 0), 159: ("z = 8", 1), 160: ("z = 6 AND h IN (3, 4) AND NOT arom", 0), 161: ("z = 7", 0), 162: ("arom", 0), 164: ("z = 8", 0), 165: ("in_ring", 0),
    }


def atom_keys() -> str:
    tests = atom_key_tests()
    assert set(tests) == set(ATOM_KEYS)
    return BASE + "\n" + "\nUNION ALL ".join(f"SELECT mol_id, CAST({k} AS INTEGER) AS bit FROM atoms WHERE {test} GROUP BY mol_id HAVING count(*) > {n}" for k, (test, n) in sorted(tests.items()))


def path_keys() -> str:
    hetero = "{}.z NOT IN (1, 6)"
    two = {
        14: ("x.z = 16", "d.kind = 'single'", "y.z = 16"), 17: ("x.z = 6", "d.o = 3", "y.z = 6"), 24: ("x.z = 7", "d.kind = 'single'", "y.z = 8"), 31: (hetero.format("x"), "true", "y.z IN (9, 17, 35, 53)"),
        33: ("x.z = 7", "true", "y.z = 16"), 40: ("x.z = 16", "d.kind = 'single'", "y.z = 8"), 41: ("x.z = 6", "d.o = 3", "y.z = 7"), 52: ("x.z = 7", "true", "y.z = 7"), 60: ("x.z = 16", "d.o = 2", "y.z = 8"),
        63: ("x.z = 7", "d.o = 2", "y.z = 8"), 67: (hetero.format("x"), "true", "y.z = 16"), 71: ("x.z = 7", "true", "y.z = 8"), 78: ("x.z = 6", "d.o = 2", "y.z = 7"), 94: (hetero.format("x"), "true", "y.z = 7"),
        99: ("x.z = 6", "d.o = 2", "y.z = 6"), 102: (hetero.format("x"), "true", "y.z = 8"), 124: (hetero.format("x"), "true", hetero.format("y")), 154: ("x.z = 6", "d.o = 2", "y.z = 8"),
        157: ("x.z = 6", "d.kind = 'single'", "y.z = 8"), 158: ("x.z = 6", "d.kind = 'single'", "y.z = 7"),
    }
    three = {77: ("x.z = 7", "true", "y.z = 7"), 110: ("x.z = 7", "m.z = 6", "y.z = 8"), 117: ("x.z = 7", "true", "y.z = 8"), 123: ("x.z = 8", "m.z = 6", "y.z = 8")}
    assert {*two, *three} == set(PATH_KEYS)
    ends = "JOIN atoms x ON x.mol_id = d.mol_id AND x.atom = d.atom JOIN atoms y ON y.mol_id = d.mol_id AND y.atom = {}.other"
    parts = [f"SELECT DISTINCT d.mol_id, CAST({k} AS INTEGER) AS bit FROM dir d {ends.format('d')} WHERE {a} AND {b} AND {c}" for k, (a, b, c) in two.items()]
    middle = "JOIN dir e ON e.mol_id = d.mol_id AND e.atom = d.other AND e.other <> d.atom JOIN atoms m ON m.mol_id = d.mol_id AND m.atom = d.other"
    parts += [f"SELECT DISTINCT d.mol_id, CAST({k} AS INTEGER) AS bit FROM dir d {middle} {ends.format('e')} WHERE {a} AND {b} AND {c}" for k, (a, b, c) in three.items()]
    return BASE + "\n" + "\nUNION ALL ".join(parts)


def with_hydrogens() -> str:
    """BASE for molecules whose hydrogens are atoms: the atom table, the directed bonds and the invariants after it know them."""
    head, mark, tail = BASE.partition("dox AS (")
    head = head.replace("dir AS MATERIALIZED", "dir0 AS MATERIALIZED").replace("FROM dir GROUP BY ALL)", "FROM dir0 GROUP BY ALL)").replace("atoms AS MATERIALIZED", "atoms0 AS MATERIALIZED")
    more = """size AS (SELECT mol_id, count(*) AS n FROM atoms0 GROUP BY ALL),
hy AS MATERIALIZED (SELECT mol_id, atom, comp, CAST(n + row_number() OVER (PARTITION BY mol_id ORDER BY atom, j) - 1 AS INTEGER) AS hatom FROM (SELECT a.mol_id, a.atom, a.comp, n, unnest(range(0, a.h)) AS j FROM atoms0 a JOIN size USING (mol_id))),
dir AS MATERIALIZED (SELECT * FROM dir0 UNION ALL SELECT mol_id, atom, hatom, atom * 1000 + hatom, 'single', 1 FROM hy UNION ALL SELECT mol_id, hatom, atom, atom * 1000 + hatom, 'single', 1 FROM hy),
atoms AS MATERIALIZED (SELECT mol_id, atom, z, charge, delta, arom, in_ring, comp, degree, orders, unsat, has_single, h FROM atoms0
  UNION ALL SELECT mol_id, hatom, 1, 0, 0, false, false, comp, 1, 1, 0, true, 0 FROM hy),
"""
    return head + more + mark + tail


def metal_pi() -> str:
    """The rules for the pi electrons of METALS, as a condition and a value for each family."""
    rules = [
        ((25, 43, 75), "CASE WHEN degree = 1 THEN unsat WHEN degree = 2 AND NOT single THEN CASE unsat WHEN 4 THEN 1 ELSE unsat END ELSE 0 END"),
        ((24, 42, 74, 90, 92, 93), "CASE WHEN degree IN (1, 2) OR degree = 3 AND unsat >= 2 THEN unsat ELSE 0 END"),
        ((23, 41, 73), "CASE WHEN degree <= 3 THEN unsat ELSE 0 END"),
        ((26, 44, 76), "CASE WHEN degree = 1 AND unsat >= 2 THEN unsat WHEN degree = 3 AND unsat = 1 THEN 1 WHEN degree = 4 AND unsat = 2 THEN 2 ELSE 0 END"),
        ((27, 45, 77), "CASE WHEN degree IN (2, 3) AND unsat = 1 THEN 1 WHEN degree = 4 AND unsat = 2 THEN 2 ELSE 0 END"),
        ((28, 46, 78, 66), "CASE WHEN unsat = degree THEN unsat ELSE 0 END"),
        ((65,), "0"),
    ]
    return "CASE WHEN unsat = 0 THEN 0 " + " ".join(f"WHEN z IN ({', '.join(map(str, of))}) THEN {then}" for of, then in rules) + " ELSE unsat END"


MOL_SMILES = f"""SELECT p_partkey AS mol_id, array_to_string(list_transform(range(0, 1 + p_size % 4), lambda i: {FRAGMENTS!r}[1 + ((p_partkey >> CAST(4 * i AS INTEGER)) + p_size * (2 * i + 1)) % 16]), '')
  || CASE WHEN p_size % 10 = 0 THEN '.[Na+]' WHEN p_size % 11 = 0 THEN 'OCl(=O)=O' ELSE '' END AS smiles FROM part"""

ORACLES: dict[str, str] = {
    "mol_smiles": MOL_SMILES,
    "mol_atoms": BASE + "SELECT mol_id, atom, CAST(z AS INTEGER) AS z, CAST(charge AS INTEGER) AS charge, arom AS aromatic, CAST(h AS INTEGER) AS h, in_ring, CAST(comp AS INTEGER) AS comp, CAST(delta AS INTEGER) AS delta_mass FROM atoms",
    "mol_bonds": BASE + "SELECT mol_id, least(a, b) AS a, greatest(a, b) AS b, kind, in_ring FROM bonds",
    "mol_degree": BASE + "SELECT mol_id, atom, CAST(degree AS INTEGER) AS degree, CAST(orders AS INTEGER) AS orders FROM atoms",
    "mol_components": BASE + """SELECT mol_id, CAST(count(*) AS INTEGER) AS n_atoms, CAST((SELECT count(*) FROM bonds b WHERE b.mol_id = a.mol_id) AS INTEGER) AS n_bonds,
  CAST((SELECT count(*) FROM po WHERE po.mol_id = a.mol_id AND frag IN (6, 7, 8)) AS INTEGER) AS n_rings, CAST(count(DISTINCT comp) AS INTEGER) AS n_fragments FROM atoms a GROUP BY mol_id""",
    "mol_accessors": BASE + """SELECT mol_id, CAST(count(*) AS INTEGER) AS n_atoms, false AS empty, coalesce(max(degree) > 0, false) AS has_edges, CAST(sum(degree) AS INTEGER) AS n_entries, CAST(max(CASE WHEN atom = 0 THEN z END) AS INTEGER) AS first_z, CAST(NULL AS INTEGER) AS outside_z,
  CAST(coalesce(max(CASE WHEN atom = 1 THEN degree END), 0) AS INTEGER) AS n_at_second, CAST(coalesce((SELECT sum(other) FROM dir d WHERE d.mol_id = a.mol_id AND d.atom = 1), 0) AS INTEGER) AS sum_at_second, CAST(sum(degree) AS INTEGER) AS n_neighbours FROM atoms a GROUP BY mol_id""",
    "mol_directed": BASE + "SELECT mol_id, atom, other, kind FROM dir",
    "hash_atom_invariant": BASE + f"SELECT mol_id, atom, CAST({invariant(True)} AS BIGINT) AS inv FROM inv",
    "hash_atom_invariant_no_ring": BASE + f"SELECT mol_id, atom, CAST({invariant(False)} AS BIGINT) AS inv FROM inv",
    "bond_invariant": BASE + f"SELECT d.mol_id, d.atom AS a, d.other AS b, {bond_value(True)} AS inv FROM dir d {ENDS} WHERE d.atom < d.other",
    "bond_invariant_no_types": BASE + "SELECT mol_id, atom AS a, other AS b, CAST(1 AS BIGINT) AS inv FROM dir WHERE atom < other",
    **{f"ecfp_bits_r{r}_n{n}": ecfp_bits(r, n) for r in range(4) for n in (64, 2048)},
    "ecfp_bits_no_bond_types": ecfp_bits(2, 2048, types=False),
    "ecfp_bits_no_ring": ecfp_bits(2, 2048, ring=False),
    "ecfp_count_r2": ecfp_counts(2048),
    "ecfp_count_n1000": ecfp_counts(1000),
    "ecfp_layered_r2": LAYERED,
    "atom_pair_codes": BASE + f"SELECT mol_id, atom, CAST(pi AS INTEGER) AS pi, {code(0)} AS code FROM codes",
    "atom_pair_distances": DISTANCES + "SELECT mol_id, a, b, d FROM dist WHERE a < b AND d >= 1",
    "atom_pair_bits": pair_bits(),
    "atom_pair_bits_nosim": pair_bits(simulate=False),
    "atom_pair_bits_dist_2_5": pair_bits(2, 5),
    "atom_pair_bits_raw": pair_bits(),
    "torsion_codes": BASE + f"SELECT mol_id, atom, {code(1)} AS end_code, {code(2)} AS inner_code FROM codes",
    "torsion_paths": paths(4, BASE) + "SELECT mol_id, p[1] AS a0, p[2] AS a1, p[3] AS a2, p[4] AS a3 FROM pth",
    "torsion_bits": torsion_bits(),
    "torsion_bits_nosim": torsion_bits(simulate=False),
    "torsion_bits_shortest": torsion_bits(shortest=True),
    "torsion_bits_k5": torsion_bits(5),
    "torsion_bits_raw": torsion_bits(),
    "maccs_single_atom": atom_keys(),
    "maccs_single_atom_patterns": atom_keys(),
    "maccs_special": BASE + """SELECT mol_id, CAST((SELECT count(*) FROM po WHERE po.mol_id = a.mol_id AND frag IN (6, 8)) AS INTEGER) AS aromatic_rings, CAST(count(DISTINCT comp) AS INTEGER) AS fragments FROM atoms a GROUP BY mol_id""",
    "maccs_paths": path_keys(),
    "fp_accessors": emitted(2) + """
SELECT mol_id, CAST(2048 AS INTEGER) AS length, bool_or(hash % 2048 = 1057) AS has_1057, false AS has_outside, false AS no_length, CAST(count(DISTINCT hash % 2048) AS INTEGER) AS n_bits,
  count(*) FILTER (WHERE hash % 2048 = 1057) AS count_1057, CAST(0 AS BIGINT) AS count_outside, count(*) AS n_counts, CAST(count(DISTINCT hash % 2048) AS INTEGER) AS n_after_outside FROM em GROUP BY mol_id""",
    "fp_layer_rollup": emitted(2) + "\nSELECT mol_id, CAST(layer AS INTEGER) AS layer, count(*) AS cnt FROM em GROUP BY ROLLUP (mol_id, layer)",
    "explicit_h_counts": ecfp_counts(2048, with_hydrogens()),
    "explicit_h_atoms": BASE + """SELECT mol_id, CAST(count(*) + sum(h) AS INTEGER) AS n_atoms, CAST((SELECT count(*) FROM bonds b WHERE b.mol_id = a.mol_id) + sum(h) AS INTEGER) AS n_bonds, CAST(sum(h) AS INTEGER) AS n_hydrogens FROM atoms a GROUP BY mol_id""",
    "pi_electrons_metals": f"""WITH p AS (SELECT p_partkey AS mol_id, {[z for z, _ in METALS]}[1 + p_partkey % {len(METALS)}] AS z, (p_partkey * 7 + p_size * 11) % 256 AS c FROM part),
o AS (SELECT mol_id, z, list_filter([c % 4, (c // 4) % 4, (c // 16) % 4, c // 64], lambda x: x > 0) AS orders FROM p),
d AS (SELECT mol_id, z, CAST(len(orders) AS INTEGER) AS degree, CAST(coalesce(list_sum(orders), 0) AS INTEGER) - len(orders) AS unsat, list_contains(orders, 1) AS single FROM o),
r AS (SELECT mol_id, z, degree, CAST({metal_pi()} AS INTEGER) AS pi FROM d)
SELECT mol_id, CAST(z AS INTEGER) AS z, degree, pi, CAST(degree % 7 + pi % 3 * 8 + 15 * 32 AS BIGINT) AS code FROM r""",
    "fp_filtered": f"SELECT mol_id, CAST(count(*) AS INTEGER) AS n_bits FROM ({ecfp_bits(3, 2048)}) GROUP BY mol_id HAVING count(*) >= 12 AND bool_or(bit = 1057)",
    "smiles_guarded": f"SELECT mol_id, CAST(strlen(repeat(smiles, 1 + mol_id % 9)) AS INTEGER) AS n_bytes FROM ({MOL_SMILES}) WHERE strlen(repeat(smiles, 1 + mol_id % 9)) BETWEEN 1 AND 128",
    "smiles_errors": "SELECT p_partkey AS mol_id, p_partkey % 4 = 0 AS prepared, CASE WHEN p_partkey % 4 > 0 THEN true END AS has_error FROM part",
    "ecfp_zero_size": "SELECT p_partkey AS mol_id, CAST(0 AS INTEGER) AS length, CAST(0 AS INTEGER) AS n_bits FROM part",
    "custom_algorithm": BASE + "SELECT DISTINCT mol_id, CAST(z AS INTEGER) AS bit FROM atoms",
    "custom_invariants": BASE + "SELECT DISTINCT mol_id, CAST(z AS INTEGER) AS bit FROM atoms",
    "custom_codes": pair_bits(simulate=False, codes="(SELECT mol_id, atom, CAST(z AS BIGINT) AS c FROM atoms)"),
}
