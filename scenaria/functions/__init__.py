"""Column functions. Everything here builds JVM-side expressions only."""

from scenaria.functions.numeric import (  # noqa: F401
    carrier_equivalent,
    discount_factor,
    lookup,
    percent_of,
    recode,
    scaled,
    sign_flip,
    strict_avg,
    strict_sum,
    symmetric_limit,
    to_number,
    weighted_mean,
    year_bin,
)
from scenaria.functions.text import (  # noqa: F401
    capture,
    class_of_ends,
    detect,
    first_match,
    link_label,
    link_scope,
    same_prefix,
    same_site,
    strip_bus,
    sub,
)
from scenaria.functions.timeslice import (  # noqa: F401
    date_of_day,
    day_of_hour,
    hour_window,
    month_day,
    slice_hour,
    timestamp_of_hour,
)
