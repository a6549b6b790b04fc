"""Table operators: DataFrame in, DataFrame out, no actions except where noted."""

from scenaria.operators.aggregate import (  # noqa: F401
    allocate_to_ends,
    collapse,
    decade_sum,
    discounted_sum,
    extents,
    grouped_mean,
    grouped_sum,
    is_unused,
    with_totals,
    with_weighted_totals,
)
from scenaria.operators.category import (  # noqa: F401
    as_category,
    attach_dimension,
    classify,
    display_order,
    with_scenario_category,
)
from scenaria.operators.columns import categories_to_text, map_columns, select_renamed, swap  # noqa: F401
from scenaria.operators.flows import (  # noqa: F401
    country_net_flow,
    directed_flow,
    import_export,
    link_signed_flow,
    node_trade,
    reorient,
)
from scenaria.operators.joins import code_join, natural_join, role_join, semi_join, shared, union_rows  # noqa: F401
from scenaria.operators.links import split_link  # noqa: F401
from scenaria.operators.rank import duration_curve, rank_rows  # noqa: F401
from scenaria.operators.reshape import (  # noqa: F401
    complete,
    complete_series,
    complete_sum,
    contrast,
    delta_vs_baseline,
    densify,
    pivot_longer,
    pivot_wider,
)
from scenaria.operators.series import carry_backward, interpolate, share_of_total  # noqa: F401
