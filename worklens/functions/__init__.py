from worklens.functions.bands import (  # noqa: F401
    band_confidence, band_health, band_heat_risk, band_heat_score, band_person,
)
from worklens.functions.noise import add_normals  # noqa: F401
from worklens.functions.scalar import (  # noqa: F401
    clip, fixed_text, percent_text, ratio, round_half_up, settle, zero_to,
)
