"""Elements: symbols, standard weights, normal valences, isotope masses."""

from __future__ import annotations

# Symbols by atomic number, and standard atomic weights to three decimals
# (for elements without one: the mass number of the longest-lived isotope that is customary).
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
WEIGHTS = [
    1.008, 4.003, 6.941, 9.012, 10.812, 12.011, 14.007, 15.999, 18.998, 20.18, 22.99, 24.305, 26.982, 28.086, 30.974, 32.067, 35.453, 39.948,
    39.098, 40.078, 44.956, 47.867, 50.942, 51.996, 54.938, 55.845, 58.933, 58.693, 63.546, 65.39, 69.723, 72.61, 74.922, 78.96, 79.904, 83.8,
    85.468, 87.62, 88.906, 91.224, 92.906, 95.94, 98.0, 101.07, 102.906, 106.42, 107.868, 112.412, 114.818, 118.711, 121.76, 127.6, 126.904, 131.29,
    132.905, 137.328, 138.906, 140.116, 140.908, 144.24, 145.0, 150.36, 151.964, 157.25, 158.925, 162.5, 164.93, 167.26, 168.934, 173.04, 174.967,
    178.49, 180.948, 183.84, 186.207, 190.23, 192.217, 195.078, 196.967, 200.59, 204.383, 207.2, 208.98, 209.0, 210.0, 222.0, 223.0, 226.0, 227.0,
    232.038, 231.036, 238.029, 237.0, 244.0, 243.0, 247.0, 247.0, 251.0, 252.0, 257.0, 258.0, 259.0, 262.0, 267.0, 268.0, 269.0, 270.0, 269.0, 278.0,
    281.0, 281.0, 285.0, 284.0, 289.0, 288.0, 293.0, 292.0, 294.0,
]
# Masses of light and of often used isotopes, (atomic number, mass number): mass.
MASSES = {
    (1, 1): 1.00783, (1, 2): 2.0141, (1, 3): 3.01605, (2, 3): 3.01603, (2, 4): 4.0026, (3, 6): 6.01512, (3, 7): 7.016, (5, 10): 10.01294, (5, 11): 11.00931,
    (6, 11): 11.01143, (6, 12): 12.0, (6, 13): 13.00335, (6, 14): 14.00324, (7, 13): 13.00574, (7, 14): 14.00307, (7, 15): 15.00011, (8, 15): 15.00307, (8, 16): 15.99491,
    (8, 17): 16.99913, (8, 18): 17.99916, (9, 18): 18.00094, (9, 19): 18.9984, (11, 22): 21.99444, (11, 24): 23.99096, (15, 31): 30.97376, (15, 32): 31.97391, (15, 33): 32.97173,
    (16, 32): 31.97207, (16, 33): 32.97146, (16, 34): 33.96787, (16, 35): 34.96903, (17, 35): 34.96885, (17, 36): 35.96831, (17, 37): 36.9659, (35, 76): 75.92454, (35, 77): 76.92138,
    (35, 79): 78.91834, (35, 81): 80.91629, (35, 82): 81.9168, (53, 123): 122.90559, (53, 124): 123.90621, (53, 125): 124.90463, (53, 127): 126.90447, (53, 131): 130.90612,
}
NUMBERS = {s: k + 1 for k, s in enumerate(SYMBOLS)}
ORGANIC = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
AROMATIC = ("b", "c", "n", "o", "p", "s", "se", "as", "te", "si")
# The most usual valence, from the column of the periodic table; 0 where none is usual.
USUAL = {1: 1, 3: 1, 4: 2, 5: 3, 6: 4, 7: 3, 8: 2, 9: 1, 11: 1, 12: 2, 13: 3, 14: 4, 15: 3, 16: 2, 17: 1, 19: 1, 20: 2, 31: 3, 32: 4, 33: 3, 34: 2, 35: 1, 50: 4, 51: 3, 52: 2, 53: 1}


def outer_electrons(z: int) -> int:
    """Electrons of the outer shell of a main-group element; of others, 2."""
    for noble, size in ((2, 8), (10, 8), (18, 18), (36, 18), (54, 32), (86, 32)):
        if noble < z <= noble + size:
            k = z - noble
            return k if size == 8 or k <= 2 else k - (size - 8) if k > size - 6 else 2
    return z


def isotope_mass(z: int, number: int) -> float | None:
    """Mass of an isotope: tabulated, else by the liquid-drop formula (a few thousandths off); None where no nucleus is near."""
    if (z, number) in MASSES:
        return MASSES[z, number]
    if not 1 <= z <= 118 or not z <= number <= 3 * z + 2:
        return None
    n = number - z
    pair = 0.0 if number % 2 else (1 if z % 2 == 0 else -1) * 12.0 / number**0.5
    binding = 15.75 * number - 17.8 * number ** (2 / 3) - 0.711 * z * (z - 1) / number ** (1 / 3) - 23.7 * (n - z) ** 2 / number + pair
    return z * 1.007825 + n * 1.008665 - binding / 931.494


def delta_mass(z: int, isotope: int | None) -> int:
    """Isotope mass less the element's weight, without its fraction; 0 without an isotope, for an unknown one and for wildcards."""
    if not z or isotope is None or (mass := isotope_mass(z, isotope)) is None:
        return 0
    return int(mass - WEIGHTS[z - 1])
