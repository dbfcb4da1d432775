"""Feature presets of the visual state and the lookups that pick them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import fnv_bucket, md5_bucket, text_key

# Every category with the words it holds before the first prompt.
INITIAL_STATE = {
    "subject_form": ["sphere"],
    "material_substance": ["glass"],
    "texture_density": ["smooth"],
    "light_behavior": ["soft ambient light"],
    "color_logic": ["monochromatic"],
    "atmosphere_field": ["dust motes"],
    "phenomenon_pattern": ["crystallization"],
    "spatial_logic": ["symmetrical"],
    "scale_perspective": ["eye level"],
    "temporal_state": ["suspended"],
    "setting_location": ["void"],
    "medium_render": ["3d render"],
}
CATEGORIES = list(INITIAL_STATE)

# Template to geometry kind and to palette.
TEMPLATE_KIND = {
    "material_study": "mesh_filled",
    "textural_macro": "heightmap",
    "environmental": "heightmap",
    "atmospheric_depth": "point_cloud",
    "process_state": "mesh_filled",
    "material_collision": "dual_mesh",
    "specimen": "mesh_wireframe",
    "minimal_object": "surface_direct",
    "abstract_field": "point_cloud",
    "temporal_diptych": "dual_mesh",
    "liminal": "mesh_wireframe",
    "ruin_state": "mesh_filled",
    "essence": "surface_direct",
    "site_decay": "voxel_grid",
}
DEFAULT_KIND = "mesh_filled"
TEMPLATE_PALETTE = {
    "material_study": "amber",
    "textural_macro": "amber",
    "environmental": "ocean",
    "atmospheric_depth": "ocean",
    "process_state": "ember",
    "material_collision": "ember",
    "specimen": "frost",
    "minimal_object": "frost",
    "abstract_field": "void",
    "temporal_diptych": "void",
    "liminal": "cyberpunk",
    "ruin_state": "cyberpunk",
    "essence": "biomech",
    "site_decay": "matrix",
}
DEFAULT_PALETTE = "matrix"

# Preset lists picked by an md5 bucket of the word.
LIGHTS = ["directional_above", "dramatic_side", "rim", "wrap_soft", "wrap_strong", "overhead", "low_angle", "backlight"]
CAMERAS = ["front", "elevated", "side", "isometric", "close", "far", "low", "orbit"]
SPEEDS = [0.3, 0.5, 0.7, 1.0, 1.3, 1.6, 2.0, 0.8]
ZOOM_OFFSETS = [-0.8, -0.5, -0.3, 0.0, 0.3, 0.5, 0.8, 1.2]

# Camera positions and targets.
CAMERA_POSITION = {
    "front": (0.0, 0.0, 2.5),
    "elevated": (0.0, 1.0, 2.2),
    "side": (2.2, 0.3, 0.8),
    "isometric": (1.8, 1.4, 1.8),
    "close": (0.0, 0.2, 1.8),
    "far": (0.0, 0.3, 3.5),
    "low": (0.0, -0.3, 2.5),
    "orbit": (1.8, 0.3, 1.8),
}
CAMERA_TARGET = {"low": (0.0, 0.2, 0.0)}
DEFAULT_CAMERA = (0.0, 0.3, 2.5)

# Surface ramps (picked by FNV bucket, in name order), particle and effect keywords.
SURFACES = ["ascii", "block", "bone", "ceramic", "circuit", "donut", "ferrofluid", "glass", "minimal", "organic", "silk"]
DEFAULT_SURFACE = "donut"
PARTICLES = ["fog", "smoke", "dust", "ember", "rain", "snow", "spore", "data"]
PARTICLE_KEYWORDS = {
    "fog": "fog",
    "smoke": "smoke",
    "dust": "dust",
    "dust motes": "dust",
    "dust_motes": "dust",
    "ember": "ember",
    "embers": "ember",
    "rain": "rain",
    "snow": "snow",
    "spore": "spore",
    "spores": "spore",
    "data": "data",
    "data_stream": "data",
    "data stream": "data",
}
EFFECT_KEYWORDS = {
    "oil_impasto": ["bloom", "edge_glow"],
    "charcoal": ["noise_grain", "edge_glow", "vignette"],
    "risograph": ["scanlines", "noise_grain"],
    "daguerreotype": ["vignette", "noise_grain"],
    "3d_render": [],
    "3d render": [],
    "glitch_art": ["scanlines", "noise_grain", "crt_warp"],
    "crt": ["scanlines", "crt_warp", "bloom"],
    "blueprint": ["scanlines", "edge_glow"],
}
EFFECT_FALLBACKS = [
    ["vignette"],
    ["scanlines", "bloom"],
    ["noise_grain", "edge_glow"],
    ["vignette", "scanlines"],
    ["bloom", "noise_grain"],
    ["edge_glow", "vignette"],
    ["crt_warp", "scanlines"],
    ["bloom", "edge_glow", "vignette"],
]


def literal_map(values: dict) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def lookup(values: dict, key: Column, default) -> Column:
    """Map lookup with a default."""
    return F.coalesce(F.try_element_at(literal_map(values), key), F.lit(default))


def pick(values: list, index: Column) -> Column:
    return F.get(F.lit(values), index.cast("int"))


def keyword_or_bucket(word: Column, keywords: dict, fallbacks: list) -> Column:
    """Preset of an exact keyword, else the FNV bucket of the word."""
    key = text_key(word)
    return F.coalesce(F.try_element_at(literal_map(keywords), key), pick(fallbacks, fnv_bucket(key, len(fallbacks))))


def joined(stacks: dict | list):
    """Effect stacks as text, so that an empty stack differs from a missing one."""
    if isinstance(stacks, dict):
        return {k: "+".join(v) for k, v in stacks.items()}
    return ["+".join(v) for v in stacks]


def features(state: Column, template_id: Column) -> dict[str, Column]:
    """Derived features of a state map: each takes the first word of one slot, or a default when empty."""
    first = lambda c: F.get(F.try_element_at(state, F.lit(c)), F.lit(0))

    def when(c: str, value, default) -> Column:
        return F.when(first(c).isNull(), F.lit(default)).otherwise(value(first(c)))

    camera = when("spatial_logic", lambda w: pick(CAMERAS, md5_bucket(w, len(CAMERAS))), "default")
    coord = lambda values, i, d: lookup({k: v[i] for k, v in values.items()}, camera, d)
    pos = [coord(CAMERA_POSITION, i, DEFAULT_CAMERA[i]) for i in range(3)]
    tgt = [coord(CAMERA_TARGET, i, 0.0) for i in range(3)]
    zoom = when("scale_perspective", lambda w: pick(ZOOM_OFFSETS, md5_bucket(w, len(ZOOM_OFFSETS))), 0.0)
    gaze = [p - t for p, t in zip(pos, tgt)]
    reach = F.sqrt(sum((g * g for g in gaze), F.lit(0.0)))
    moved = {f"camera_{a}": p + g / reach * zoom for a, p, g in zip("xyz", pos, gaze)}
    surface = lambda w: F.when(w == "", DEFAULT_SURFACE).otherwise(pick(SURFACES, fnv_bucket(text_key(w), len(SURFACES))))
    return {
        "kind": lookup(TEMPLATE_KIND, template_id, DEFAULT_KIND),
        "palette": lookup(TEMPLATE_PALETTE, template_id, DEFAULT_PALETTE),
        "light": when("light_behavior", lambda w: pick(LIGHTS, md5_bucket(w, len(LIGHTS))), "default"),
        "camera": camera,
        **moved,
        "speed": when("temporal_state", lambda w: pick(SPEEDS, md5_bucket(w, len(SPEEDS))), 1.0),
        "detail": when("subject_form", lambda w: md5_bucket(w, 3).cast("int"), 1),
        "surface": when("material_substance", surface, DEFAULT_SURFACE),
        "effects": when("medium_render", lambda w: keyword_or_bucket(w, joined(EFFECT_KEYWORDS), joined(EFFECT_FALLBACKS)), ""),
        "particles": F.when(first("atmosphere_field").isNotNull(), keyword_or_bucket(first("atmosphere_field"), PARTICLE_KEYWORDS, PARTICLES)),
    }
