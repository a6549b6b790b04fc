"""All registered queries."""

from scenaria.workload import q_balance, q_capacity, q_costs, q_inputs, q_mix, q_prices, q_trade  # noqa: F401
from scenaria.workload.registry import QUERIES  # noqa: F401
