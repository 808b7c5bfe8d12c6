"""Configuration of the grid pipeline: nested settings, overlaid by a YAML file key by key.

An unreadable or malformed file gives the defaults with a warning; a value of the wrong type raises.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, fields, replace

log = logging.getLogger(__name__)

# Accepted names and their meaning.
UNITS = ("METER", "CENTIMETER", "MILLIMETER", "INCH", "FOOT")
COORDINATE_SYSTEMS = ("IMAGE", "LEFT_HANDED_Y_UP", "RIGHT_HANDED_Y_UP", "RIGHT_HANDED_Z_UP", "RIGHT_HANDED_Z_UP_X_FWD")
DEPTH_MODES = ("PERFORMANCE", "QUALITY", "ULTRA", "NEURAL")
RESOLUTIONS = {"VGA": (672, 376), "SVGA": (800, 600), "HD720": (1280, 720), "HD1080": (1920, 1080), "HD2K": (2208, 1242)}
FALLBACK_RESOLUTION = "HD1080"
CONSUMERS = ("null", "disk", "network")


@dataclass(frozen=True)
class SourceConfig:
    coordinate_units: str = "METER"
    coordinate_system: str = "RIGHT_HANDED_Z_UP_X_FWD"
    depth_mode: str = "PERFORMANCE"
    resolution: str = "HD720"
    svo_path: str = ""
    svo_real_time: bool = False
    fps: int = 30
    frame_skip: int = 0
    w: int = 1280
    h: int = 720

    def validate(self) -> None:
        for name, known in (("coordinate_units", UNITS), ("coordinate_system", COORDINATE_SYSTEMS), ("depth_mode", DEPTH_MODES), ("resolution", tuple(RESOLUTIONS))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name}: {getattr(self, name)!r} is none of {', '.join(known)}")
        if self.frame_skip < 0:
            raise ValueError("frame_skip must not be negative")
        if self.fps <= 0:
            raise ValueError("fps must be positive")


@dataclass(frozen=True)
class VoxelConfig:
    voxel_size_x: float = 0.05
    voxel_size_y: float = 0.05
    voxel_size_z: float = 0.05
    min_points_per_voxel: int = 3


@dataclass(frozen=True)
class PolarConfig:
    z_threshold: float = 0.45
    min_range: float = 0.1


@dataclass(frozen=True)
class GridConfig:
    r_min_m: float = 0.3
    r_max_m: float = 2.0
    theta_min_deg: float = -45.0
    theta_max_deg: float = 45.0
    danger_threshold: float = 0.30
    scrit_deg: float = 30.0
    rcrit_m: float = 0.10
    hcrit_m: float = 0.20
    polar_grid_size_r_m: float = 0.10
    polar_grid_size_theta_deg: float = 5.0

    def validate(self) -> None:
        for name in ("scrit_deg", "rcrit_m", "hcrit_m", "polar_grid_size_r_m", "polar_grid_size_theta_deg"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")


@dataclass(frozen=True)
class DiskConfig:
    output_dir: str = "../output/frames"
    write_images: bool = True


@dataclass(frozen=True)
class PipelineConfig:
    zed: SourceConfig = field(default_factory=SourceConfig)
    voxel_filter: VoxelConfig = field(default_factory=VoxelConfig)
    polarize: PolarConfig = field(default_factory=PolarConfig)
    traversability: GridConfig = field(default_factory=GridConfig)
    disk_writer: DiskConfig = field(default_factory=DiskConfig)
    consumer: str = "network"

    def validate(self) -> PipelineConfig:
        self.zed.validate()
        self.traversability.validate()
        for name in ("voxel_size_x", "voxel_size_y", "voxel_size_z"):
            if getattr(self.voxel_filter, name) <= 0:
                raise ValueError(f"{name} must be positive")
        return self


def resolution_dims(name: str) -> tuple[int, int]:
    """Width and height; an unknown name gives those of the fallback, with a warning."""
    if name not in RESOLUTIONS:
        log.warning("unrecognised resolution %r, using %s", name, FALLBACK_RESOLUTION)
    return RESOLUTIONS.get(name, RESOLUTIONS[FALLBACK_RESOLUTION])


def _converted(value, kind: type, name: str):
    if kind is bool:
        if isinstance(value, bool):
            return value
    elif kind is str:
        if isinstance(value, str | int | float):
            return str(value)
    elif not isinstance(value, bool) and isinstance(value, int | float) and (kind is float or value == int(value)):
        return kind(value)
    raise TypeError(f"{name}: {value!r} isn't of type {kind.__name__}")


def overlay(base, values: dict):
    """The settings with the given keys replaced; unknown keys are ignored."""
    known = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    return replace(base, **{k: _converted(v, known[k], k) for k, v in values.items() if k in known})


def load(path: str) -> PipelineConfig:
    """Reads a YAML file; sections and keys that it lacks keep their defaults."""
    import yaml

    config = PipelineConfig()
    try:
        with open(path, encoding="utf-8") as f:
            root = yaml.safe_load(f)
        if not isinstance(root, dict):
            raise yaml.YAMLError("not a mapping")
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as why:
        log.warning("failed to load %s: %s; using defaults", path, why)
        return config
    for section in ("zed", "voxel_filter", "polarize", "traversability", "disk_writer"):
        if isinstance(root.get(section), dict):
            config = replace(config, **{section: overlay(getattr(config, section), {k: v for k, v in root[section].items() if k not in ("w", "h")})})
            if section == "zed":
                w, h = resolution_dims(config.zed.resolution)
                config = replace(config, zed=replace(config.zed, w=w, h=h))
    if root.get("consumer") is not None:
        config = replace(config, consumer=_converted(root["consumer"], str, "consumer"))
    return config


def consumer_kind(name: str) -> str:
    """The consumer a configured name stands for, in any case of letters; unknown names discard results, with a warning."""
    if name.lower() not in CONSUMERS:
        log.warning("unrecognised consumer %r, discarding results", name)
        return "null"
    return name.lower()
