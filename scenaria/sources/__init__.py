"""Readers and writers of the domain's files."""

from scenaria.sources.inline import inline_table, sql_literal, variable_table  # noqa: F401
from scenaria.sources.sinks import write_by_key, write_table  # noqa: F401
from scenaria.sources.tables import (  # noqa: F401
    INDEX_TYPES,
    read_gdp,
    read_node_attributes,
    read_parameter,
    read_scenario_matrix,
    read_scenarios,
    read_set,
    read_scenario_tree,
    read_yearly_files,
)
