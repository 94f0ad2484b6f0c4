"""How detectors respond to a wave from a place in the sky, as SQL expressions of right ascension, declination and polarisation (radians)."""

from __future__ import annotations

LIGHT = 299792458.0
#: Response tensors of the detectors, and where they are from the Earth's centre in metres.
RESPONSE = {
    "H1": [[-0.3926141, -0.0776130, -0.2473886], [-0.0776130, 0.3195244, 0.2279981], [-0.2473886, 0.2279981, 0.0730903]],
    "L1": [[0.4112809, 0.1402097, 0.2472943], [0.1402097, -0.1090056, -0.1816157], [0.2472943, -0.1816157, -0.3022755]],
    "V1": [[0.2438740, -0.0990838, -0.2325762], [-0.0990838, -0.4478258, 0.1878331], [-0.2325762, 0.1878331, 0.2039518]],
}
PLACE = {
    "H1": (-2161414.92636, -3834695.17889, 4600350.22664),
    "L1": (-74276.0447238, -5496283.71971, 3224257.01744),
    "V1": (4546374.0990, 842989.697626, 4378576.96241),
}


def _bilinear(a: list[str], tensor: list[list[float]], b: list[str]) -> str:
    return " + ".join(f"({a[i]}) * ({tensor[i][j]!r}) * ({b[j]})" for i in range(3) for j in range(3))


def antenna(detector: str, ra: str = "ra", dec: str = "dec", psi: str = "psi") -> tuple[str, str]:
    """The factors of the plus and the cross polarisation, at a sidereal time of 0."""
    # the wave's axes across the line of sight, turned by the polarisation angle
    east = [f"-sin({ra})", f"cos({ra})", "0.0"]
    north = [f"-cos({ra}) * sin({dec})", f"-sin({ra}) * sin({dec})", f"cos({dec})"]
    x = [f"-cos({psi}) * ({e}) + sin({psi}) * ({n})" for e, n in zip(east, north)]
    y = [f"sin({psi}) * ({e}) + cos({psi}) * ({n})" for e, n in zip(east, north)]
    d = RESPONSE[detector]
    return f"({_bilinear(x, d, x)}) - ({_bilinear(y, d, y)})", f"({_bilinear(x, d, y)}) + ({_bilinear(y, d, x)})"


def delay(detector: str, ra: str = "ra", dec: str = "dec") -> str:
    """Seconds from the wave's passing of the Earth's centre to its arrival; negative where it arrives before."""
    a, b, c = PLACE[detector]
    return f"-({a!r} * cos({ra}) * cos({dec}) + {b!r} * sin({ra}) * cos({dec}) + {c!r} * sin({dec})) / {LIGHT!r}"
