"""Simulated flights: path, inertial drift, sensors. Every draw comes from a seed, so reruns agree."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fluxlane.operators import navigation as nav
from fluxlane.operators.grid import Interpolant


@dataclass(frozen=True)
class Flight:
    """What a simulated flight is like."""

    seconds: float = 300.0
    dt: float = 0.1
    speed: float = 68.0
    alt: float = 1000.0
    lat: float = 0.54
    lon: float = -1.44
    waves: int = 1
    attempts: int = 10


def gauss_markov(rng: np.random.Generator, sigma: float, tau: float, dt: float, n: int) -> np.ndarray:
    phi, q = np.exp(-dt / tau), np.sqrt(2 * sigma**2 / tau * dt)
    x = np.empty(n)
    x[0] = sigma * rng.standard_normal()
    w = rng.standard_normal(n)
    for i in range(1, n):
        x[i] = phi * x[i - 1] + q * w[i]
    return x


def _slope(x: np.ndarray) -> np.ndarray:
    """Central differences; one-sided at the ends."""
    return np.gradient(x) if len(x) > 2 else np.zeros_like(x)


def euler_matrices(roll: np.ndarray, pitch: np.ndarray, yaw: np.ndarray) -> np.ndarray:
    """Body-to-navigation matrices: a turn by roll, then pitch, then yaw."""
    one, zero = np.ones_like(roll), np.zeros_like(roll)
    stack = lambda *rows: np.stack([np.stack(r, -1) for r in rows], -2)
    x = stack((one, zero, zero), (zero, np.cos(roll), -np.sin(roll)), (zero, np.sin(roll), np.cos(roll)))
    y = stack((np.cos(pitch), zero, np.sin(pitch)), (zero, one, zero), (-np.sin(pitch), zero, np.cos(pitch)))
    z = stack((np.cos(yaw), -np.sin(yaw), zero), (np.sin(yaw), np.cos(yaw), zero), (zero, zero, one))
    return z @ y @ x


def trajectory(f: Flight, rng: np.random.Generator, surface: Interpolant | None = None) -> pd.DataFrame:
    """A straight line in a random direction with sine waves across it, scaled to its length; tried again if it leaves the map."""
    n = int(round(f.seconds / f.dt)) + 1
    t = np.arange(n) * f.dt
    for _ in range(f.attempts):
        heading, along, across = rng.uniform(0, 2 * np.pi), np.linspace(0, 1, n), np.zeros(n)
        for _ in range(f.waves):
            across += rng.uniform(0, 0.05) * np.sin(2 * np.pi * rng.uniform(0.5, 2) * along)
        length = np.hypot(np.diff(along), np.diff(across)).sum()
        scale = f.speed * f.seconds / length
        north, east = scale * (along * np.cos(heading) - across * np.sin(heading)), scale * (along * np.sin(heading) + across * np.cos(heading))
        m_lat, m_lon = nav._metres(np.array(f.lat))
        lat, lon = f.lat + north / m_lat, f.lon + east / m_lon
        if surface is None:
            break
        a = surface.a
        iy, ix = (lat - a.y0) / a.dy, (lon - a.x0) / a.dx
        if iy.min() > 0 and ix.min() > 0 and iy.max() < a.ny - 1 and ix.max() < a.nx - 1:
            break
    else:
        raise ValueError("no path on the map was found")
    vn, ve = _slope(north) / f.dt, _slope(east) / f.dt
    fn, fe = _slope(vn) / f.dt, _slope(ve) / f.dt
    out = pd.DataFrame({"tt": t, "lat": lat, "lon": lon, "alt": f.alt, "vn": vn, "ve": ve, "vd": 0.0, "fn": fn, "fe": fe, "fd": -9.80665})
    wobble = [np.deg2rad(2) * gauss_markov(rng, 1.0, 2.0, f.dt, n) for _ in range(2)]
    out["cnb"] = list(euler_matrices(wobble[0], wobble[1], np.arctan2(ve, vn)).reshape(n, 9))
    return out


def inertial(path: pd.DataFrame, m: nav.Model, rng: np.random.Generator) -> pd.DataFrame:
    """The path as an inertial system reports it: Pinson errors that start from P0 and are driven by Qd."""
    motion, cnb = path[list(nav.MOTION)].to_numpy(float), np.stack(path["cnb"].to_numpy()).reshape(-1, 3, 3)
    phi, q, p0 = nav.transition(motion, cnb, m), np.sqrt(np.diag(nav.process_noise(m))), np.sqrt(np.diag(nav.initial_covariance(m, motion[0, 0])))
    x, out = p0 * rng.standard_normal(m.size), np.zeros((len(path), m.size))
    for i in range(len(path)):
        out[i] = x
        x = phi[i] @ x + q * rng.standard_normal(m.size)
    shown = path.copy()
    for k, name in enumerate(nav.MOTION[:6]):
        shown[name] = path[name] - out[:, k]
    return shown


def clean_sensor(path: pd.DataFrame, surface: Interpolant, rng: np.random.Generator, sigma: float = 1.0, bias: float = 1.0, tau: float = 600.0, dt: float = 0.1) -> np.ndarray:
    """The map along the path, with a slow and a white error."""
    n = len(path)
    return np.asarray(surface(path["lat"].to_numpy(), path["lon"].to_numpy())) + gauss_markov(rng, bias, tau, dt, n) + sigma * rng.standard_normal(n)


def flux(path: pd.DataFrame, field: tuple[float, float, float], rng: np.random.Generator, bias: float = 1.0, tau: float = 600.0, dt: float = 0.1) -> np.ndarray:
    """Vector sensor readings (n x 3): the Earth's field turned into the body frame, with slow errors."""
    cnb = np.stack(path["cnb"].to_numpy()).reshape(-1, 3, 3)
    body = np.einsum("nji,j->ni", cnb, np.asarray(field, float))
    return body + np.stack([gauss_markov(rng, bias, tau, dt, len(path)) for _ in range(3)], 1)


def corrupted(sensor: np.ndarray, vec: np.ndarray, rng: np.random.Generator, white: float = 1.0, drift: float = 0.001, bias: float = 1.0, tau: float = 600.0, dt: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(the sensor as the aircraft disturbs it, the 18 coefficients drawn for it)."""
    total = np.linalg.norm(vec, axis=1)
    unit, change = vec / total[:, None], np.gradient(vec, axis=0)
    upper = [(i, j) for i in range(3) for j in range(i, 3)]
    design = np.column_stack([unit, *[unit[:, i] * vec[:, j] / 50000 for i, j in upper], *[unit[:, i] * change[:, j] / 50000 for i in range(3) for j in range(3)]])
    coef = rng.standard_normal(18) * np.repeat([5.0, 5.0, 0.5], [3, 6, 9])
    n = len(sensor)
    ramp = drift * rng.random() * np.arange(n) * dt
    return sensor + white * rng.standard_normal(n) + gauss_markov(rng, bias, tau, dt, n) + ramp + design @ coef, coef


def flight(f: Flight, surface: Interpolant, seed: int, m: nav.Model | None = None) -> pd.DataFrame:
    """Truth, inertial readings and sensors of one flight."""
    rng = np.random.default_rng(seed)
    path = trajectory(f, rng, surface)
    shown = inertial(path, replace(m or nav.Model(), dt=f.dt), rng)
    vec = flux(path, (18000.0, -4000.0, 50000.0), rng, dt=f.dt)
    clean = clean_sensor(path, surface, rng, dt=f.dt)
    out = path[["tt", "lat", "lon", "alt", "vn", "ve", "vd"]].copy()
    out[["ins_lat", "ins_lon", "ins_alt"]] = shown[["lat", "lon", "alt"]]
    out[["flux_x", "flux_y", "flux_z"]] = vec
    out["mag_c"], out["mag_uc"] = clean, corrupted(clean, vec, rng, dt=f.dt)[0]
    return out


def flights(seeds: DataFrame, surface: Interpolant, f: Flight) -> DataFrame:
    """A simulated flight for each row of ``seeds`` (column seed), side by side."""
    shared = seeds.sparkSession.sparkContext.broadcast(surface)  # one map level of bounded size
    names = ["tt", "lat", "lon", "alt", "vn", "ve", "vd", "ins_lat", "ins_lon", "ins_alt", "flux_x", "flux_y", "flux_z", "mag_c", "mag_uc"]

    def run(batches):
        for b in batches:
            for seed in b["seed"]:
                out = flight(f, shared.value, int(seed))
                out.insert(0, "seed", int(seed))
                yield out

    return seeds.select(seeds["seed"].cast("long").alias("seed")).mapInPandas(run, "seed long, " + ", ".join(f"{n} double" for n in names))
