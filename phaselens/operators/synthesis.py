"""Synthesis of point-spread functions by wave optics: planes are groups, phases of a plane are rows of its result.

Quadrature and Fourier transforms have no form in SQL; they run vectorised in one function for each plane.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaselens.functions.numbers import bessel_j0
from phaselens.operators.psf import clip_planes, normalise_flux, normalise_max


@dataclass(frozen=True)
class Optics:
    """Magnification, aperture, lenslet pitch, pixels per lenslet, oversampling, index, lenslet focal length, wavelength, planes (SI units)."""

    m: float
    na: float
    pitch: float
    n: int
    osr: int
    index: float
    fml: float
    lam: float
    zmin: float
    zmax: float
    spacing: float
    tube: float = 0.2

    @property
    def depths(self) -> np.ndarray:
        return np.arange(self.zmin, self.zmax + 0.1 * self.spacing, self.spacing)

    def check(self) -> None:
        if self.n % 2 == 0 or self.osr % 2 == 0:
            raise ValueError("pixels per lenslet and oversampling must be odd")
        if len(self.depths) < 2:
            raise ValueError("two planes at least")


def pupil_integral(optics: Optics, depth: float, radius: np.ndarray, nodes: int = 400) -> np.ndarray:
    """Complex amplitude at distances from the axis (in image space), of a point at ``depth``: Gauss-Legendre over the aperture angle."""
    k = 2 * np.pi * optics.index / optics.lam
    alpha = np.arcsin(optics.na / optics.index)
    x, w = np.polynomial.legendre.leggauss(nodes)
    theta, w = (x + 1) * alpha / 2, w * alpha / 2
    u = 4 * k * depth * np.sin(alpha / 2) ** 2
    v = k * radius / optics.m * np.sin(alpha)
    phase = np.exp(-1j * u / 2 * np.sin(theta / 2) ** 2 / np.sin(alpha / 2) ** 2)
    fixed = np.sqrt(np.cos(theta)) * (1 + np.cos(theta)) * np.sin(theta) * phase * w
    out = np.empty(len(radius), complex)
    for at in range(0, len(radius), 512):
        out[at : at + 512] = bessel_j0(np.sin(theta) / np.sin(alpha) * v[at : at + 512, None]) @ fixed
    lens = optics.tube / optics.m
    return out * optics.m / (lens * optics.lam) ** 2 * np.exp(-1j * u / (4 * np.sin(alpha / 2) ** 2))


def fresnel(field: np.ndarray, step: float, distance: float, lam: float) -> np.ndarray:
    """Propagation by the transfer function."""
    k = 2 * np.pi / lam
    u, v = (np.fft.fftfreq(s, step) for s in field.shape)
    return np.exp(1j * k * distance) * np.fft.ifft2(np.fft.fft2(field) * np.exp(-2j * np.pi**2 * (u[:, None] ** 2 + v**2) * distance / k))


def support(optics: Optics, cut: float = 0.04) -> int:
    """Lenslets from the axis to where the farthest plane's intensity falls below ``cut`` of its largest."""
    step = optics.pitch / optics.n / optics.osr
    r = step * np.arange(optics.n * optics.osr * 20 + 1)
    line = np.abs(pupil_integral(optics, np.abs(optics.depths).max(), r)) ** 2
    below = np.flatnonzero(line / line.max() < cut)
    if not len(below):
        raise ValueError("the point-spread function is too large")
    return int(np.ceil(below[0] / (optics.osr * optics.n)))


def lenslets(optics: Optics, half: int) -> np.ndarray:
    """Transmission of the lenslet array on a square grid of 2 * half + 1 samples: one lenslet's phase around each centre."""
    step, size = optics.pitch / optics.n / optics.osr, optics.n * optics.osr
    at = (np.arange(-half, half + 1) + size // 2) % size - size // 2
    x = at * step
    return np.exp(-1j * (2 * np.pi / optics.lam) / (2 * optics.fml) * (x[:, None] ** 2 + x**2))


def plane(optics: Optics, z: int, depth: float, lenslets_out: int) -> pd.DataFrame:
    """Taps (z, b, a, dv, du, h) of one plane, intensities as computed."""
    half = optics.n * optics.osr * lenslets_out
    step = optics.pitch / optics.n / optics.osr
    axis = np.arange(-half, half + 1)
    squared = axis[:, None] ** 2 + axis**2
    found, where = np.unique(squared, return_inverse=True)
    wave = pupil_integral(optics, depth, step * np.sqrt(found))[where].reshape(squared.shape)
    array = lenslets(optics, half)
    rows, c, k = [], (optics.n - 1) // 2, optics.osr
    for b in range(optics.n):
        for a in range(optics.n):
            moved = np.zeros_like(wave)
            sy, sx = (b - c) * k, (a - c) * k
            src = wave[max(0, -sy) : wave.shape[0] - max(0, sy), max(0, -sx) : wave.shape[1] - max(0, sx)]
            moved[max(0, sy) : max(0, sy) + src.shape[0], max(0, sx) : max(0, sx) + src.shape[1]] = src
            seen = np.abs(fresnel(moved * array, step, optics.fml, optics.lam)) ** 2
            edge = (2 * half + 1 - k) // 2 % k
            cells = (len(axis) - edge) // k
            cut = seen[edge : edge + cells * k, edge : edge + cells * k].reshape(cells, k, cells, k).sum((1, 3))
            mid = (half - edge) // k
            v, u = np.nonzero(cut > 0)
            rows.append(pd.DataFrame({"z": z, "b": b, "a": a, "dv": v - mid - (b - c), "du": u - mid - (a - c), "h": cut[v, u]}))
    return pd.concat(rows)


def synthesise(spark: SparkSession, optics: Optics, normalised: bool = True, tolerance: float = 0.005) -> DataFrame:
    """psf (z, b, a, dv, du, h): the largest tap is 1, small ones of each plane are 0, and each phase sums to 1 if ``normalised``."""
    optics.check()
    reach = support(optics)
    far = float(np.abs(optics.depths).max())
    rows = [(i, float(d)) for i, d in enumerate(optics.depths.tolist())]
    planes = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).alias("z"), F.lit(d).alias("depth")) for i, d in rows))).alias("p")).select("p.z", "p.depth")

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        z, depth = int(pdf["z"].iloc[0]), float(pdf["depth"].iloc[0])
        return plane(optics, z, depth, max(2, int(np.ceil(reach * abs(depth) / far))))

    taps = planes.groupBy("z").applyInPandas(make, "z int, b int, a int, dv int, du int, h double")
    clipped = clip_planes(normalise_max(taps).drop("hmax"), tolerance)
    return normalise_flux(clipped) if normalised else normalise_max(clipped).drop("hmax")
