"""Names, legends, colours and code maps of the power-system domain.

Everything in this module is a fixed value: the strings have to be the ones the
model writes, otherwise the joins and filters of the plans select nothing.
"""

from __future__ import annotations

from typing import NamedTuple


class Variable(NamedTuple):
    Variable: str
    Legend: str
    Color: str


# Variables in display order (variable, legend, colour) --------

HOURLY = [
    Variable("Fin_Ene_Ele", "demand", "#003C67FF"),
    Variable("Sec_Ene_Ele_Sto_Cha_Gro_LiB", "battery charge", "#23e893"),
    Variable("Sec_Ene_Ele_Sto_Cha_Gro_PHS", "PHS charge", "#9afcc9"),
    Variable("Sec_Ene_Ele_Nuc", "nuclear", "#FF9626FF"),
    Variable("Sec_Ene_Ele_Hyd", "hydro", "#29dde3FF"),
    Variable("Sec_Ene_Ele_Geo", "geothermal", "#B74F3AFF"),
    Variable("Sec_Ene_Ele_Coa_wo_CCS", "coal w/o CCS", "#4A4F54FF"),
    Variable("Sec_Ene_Ele_Coa_w_CCS", "coal w/ CCS", "#8A9197FF"),
    Variable("Sec_Ene_Ele_Bio_wo_CCS", "biomass w/o CCS", "#617f00FF"),
    Variable("Sec_Ene_Ele_Bio_w_CCS", "biomass w/ CCS", "#a7bf5eFF"),
    Variable("Sec_Ene_Ele_Gas_wo_CCS", "gas w/o CCS", "#8c845b"),
    Variable("Sec_Ene_Ele_Gas_w_CCS", "gas w/ CCS", "#c2ac69FF"),
    Variable("Sec_Ene_Ele_Oil", "oil w/o CCS", "#8C655DFF"),
    Variable("Sec_Ene_Ele_Sto_Dis_LiB", "battery discharge", "#23e893"),
    Variable("Sec_Ene_Ele_Sto_Dis_PHS", "PHS discharge", "#9afcc9"),
    Variable("Sec_Ene_Ele_Own_Use_Ene_Sup_Hyd", "electrolysis", "orchid"),
    Variable("Sec_Ene_Ele_Cur", "curtailment", "#F6CCFFFF"),
    Variable("Sec_Ene_Ele_inc_Cur_Win_Off", "offshore wind", "#699bffFF"),
    Variable("Sec_Ene_Ele_inc_Cur_Win_Ons", "onshore wind", "#145db8"),
    Variable("Sec_Ene_Ele_inc_Cur_Solar_Dec", "solar rooftop", "#FFEE75FF"),
    Variable("Sec_Ene_Ele_inc_Cur_Solar_Cen", "solar utility", "#FEC906FF"),
    Variable("Sec_Ene_Ele_H2_FC", "fuel cell", "orchid"),
    Variable("Sec_Ene_Ele_H2_GT", "hydrogen gas turbine", "orchid"),
    Variable("Trd_Sec_Ene_Ele", "trade", "#a3e0ffFF"),
]

HOURLY_BY_ROLE = [
    Variable("Charge", "Charge", "#23e893"),
    Variable("Other", "Other", "grey50"),
    Variable("Discharge", "Discharge", "#23e893"),
    Variable("Curtailment", "Curtailment", "#F6CCFFFF"),
    Variable("Wind", "Wind", "#145db8"),
    Variable("Solar", "Solar", "#FEC906FF"),
    Variable("Transmission", "Transmission", "#a3e0ffFF"),
]

ANNUAL = [
    Variable("Sec_Ene_Ele_Trd_Los", "transmission loss", "#a3e0ffFF"),
    Variable("Sec_Ene_Ele_Cur", "curtailment", "#F6CCFFFF"),
    Variable("Sec_Ene_Ele_Sto_Los", "storage loss", "#23e893"),
    Variable("Sec_Ene_Ele_Coa_wo_CCS", "coal w/o CCS", "#4A4F54FF"),
    Variable("Sec_Ene_Ele_Coa_w_CCS", "coal w/ CCS", "#8A9197FF"),
    Variable("Sec_Ene_Ele_Oil", "oil w/o CCS", "#8C655DFF"),
    Variable("Sec_Ene_Ele_Gas_wo_CCS", "gas w/o CCS", "#8c845b"),
    Variable("Sec_Ene_Ele_Gas_w_CCS", "gas w/ CCS", "#c2ac69FF"),
    Variable("Sec_Ene_Ele_Nuc", "nuclear", "#FF9626FF"),
    Variable("Sec_Ene_Ele_Hyd", "hydro", "#29dde3FF"),
    Variable("Sec_Ene_Ele_Geo", "geothermal", "#B74F3AFF"),
    Variable("Sec_Ene_Ele_Bio_wo_CCS", "biomass w/o CCS", "#617f00FF"),
    Variable("Sec_Ene_Ele_Bio_w_CCS", "biomass w/ CCS", "#a7bf5eFF"),
    Variable("Sec_Ene_Ele_Win_Off", "offshore wind", "#699bffFF"),
    Variable("Sec_Ene_Ele_Win_Ons", "onshore wind", "#145db8"),
    Variable("Sec_Ene_Ele_Solar_Dec", "solar rooftop", "#FFEE75FF"),
    Variable("Sec_Ene_Ele_Solar_Cen", "solar utility", "#FEC906FF"),
    Variable("Sec_Ene_Ele_H2_FC", "fuel cell", "orchid"),
    Variable("Sec_Ene_Ele_H2_GT", "hydrogen gas turbine", "orchid"),
]

ANNUAL_WITH_OTHER = [
    Variable("other", "other", "#a3bdc9"),
    Variable("Sec_Ene_Ele_Coa", "coal", "#4A4F54FF"),
    Variable("Sec_Ene_Ele_Oil", "oil", "#8C655DFF"),
    Variable("Sec_Ene_Ele_Gas", "natural gas", "#A99F6DFF"),
    Variable("Sec_Ene_Ele_Bio", "biomass", "#AFDD66FF"),
    Variable("Sec_Ene_Ele_Win_Off", "offshore wind", "#699bffFF"),
    Variable("Sec_Ene_Ele_Win_Ons", "onshore wind", "#145db8"),
    Variable("Sec_Ene_Ele_Solar_Dec", "solar rooftop", "#FFEE75FF"),
    Variable("Sec_Ene_Ele_Solar_Cen", "solar utility", "#FEC906FF"),
    Variable("Sec_Ene_Ele_H2_FC", "fuel cell", "orchid"),
    Variable("Sec_Ene_Ele_H2_GT", "hydrogen gas turbine", "orchid"),
]

ANNUAL_FOSSIL = [
    Variable("Sec_Ene_Ele_Fos", "fossil", "#62696FFF"),
    Variable("Sec_Ene_Ele_Nuc", "nuclear", "#E68639FF"),
    Variable("Sec_Ene_Ele_Hyd", "hydro", "#1C9EA0FF"),
    Variable("Sec_Ene_Ele_Geo", "geothermal", "#A94A4AFF"),
    Variable("Sec_Ene_Ele_Bio", "biomass", "#A9D16AFF"),
    Variable("Sec_Ene_Ele_Win", "wind", "#145db8"),
    Variable("Sec_Ene_Ele_Solar", "solar", "#FEC906FF"),
    Variable("Sec_Ene_Ele_H2_FC", "fuel cell", "orchid"),
    Variable("Sec_Ene_Ele_H2_GT", "hydrogen gas turbine", "orchid"),
]

CAPACITY = [
    Variable("Cap_Ele_Coa_wo_CCS", "coal w/o CCS", "#4A4F54FF"),
    Variable("Cap_Ele_Coa_w_CCS", "coal w/ CCS", "#8A9197FF"),
    Variable("Cap_Ele_Oil", "oil w/o CCS", "#8C655DFF"),
    Variable("Cap_Ele_Gas_wo_CCS", "gas w/o CCS", "#A99F6DFF"),
    Variable("Cap_Ele_Gas_w_CCS", "gas w/ CCS", "#D6BD73FF"),
    Variable("Cap_Ele_Nuc", "nuclear", "#FF9626FF"),
    Variable("Cap_Ele_Hyd", "hydro", "#90d2f0FF"),
    Variable("Cap_Ele_Geo", "geothermal", "#B74F3AFF"),
    Variable("Cap_Ele_Bio_wo_CCS", "biomass w/o CCS", "#4E7F00FF"),
    Variable("Cap_Ele_Bio_w_CCS", "biomass w/ CCS", "#AFDD66FF"),
    Variable("Cap_Ele_Win_Off", "offshore wind", "#2192DEFF"),
    Variable("Cap_Ele_Win_Ons", "onshore wind", "#197EC0FF"),
    Variable("Cap_Ele_Solar_Dec", "solar rooftop", "#FFEE75FF"),
    Variable("Cap_Ele_Solar_Cen", "solar utility", "#FEC906FF"),
    Variable("Cap_Ele_H2_GT", "hydrogen gas turbine", "orchid"),
]

COST = [
    Variable("Fuel", "Fuel", "#8C655DFF"),
    Variable("OPEX", "OPEX", "#4A4F54FF"),
    Variable("CAPEX (other)", "CAPEX (other)", "#8A9197FF"),
    Variable("CAPEX (fossil w/o CCS)", "CAPEX (fossil w/o CCS)", "#8c845b"),
    Variable("CAPEX (fossil w/ CCS)", "CAPEX (fossil w/ CCS)", "#c2ac69FF"),
    Variable("CAPEX (wind)", "CAPEX (wind)", "#0252b5"),
    Variable("CAPEX (solar)", "CAPEX (solar)", "#FEC906FF"),
    Variable("CAPEX (battery)", "CAPEX (battery)", "#32AC9AFF"),
    Variable("CAPEX (hydrogen)", "CAPEX (hydrogen)", "orchid"),
    Variable("CAPEX (domestic interconnection)", "CAPEX (domestic interconnection)", "#CCEEFFFF"),
    Variable("CAPEX (international interconnection)", "CAPEX (international interconnection)", "#83d1f7FF"),
]

COST_COLLAPSED = [
    Variable("Fuel", "Fuel", "#8C655DFF"),
    Variable("OPEX", "OPEX", "#4A4F54FF"),
    Variable("CAPEX (other)", "CAPEX (other)", "#8A9197FF"),
    Variable("CAPEX (fossil)", "CAPEX (fossil)", "#c2ac69FF"),
    Variable("CAPEX (solar/wind)", "CAPEX (solar/wind)", "#FEC906FF"),
    Variable("CAPEX (battery)", "CAPEX (battery)", "#32AC9AFF"),
    Variable("CAPEX (hydrogen)", "CAPEX (hydrogen)", "orchid"),
    Variable("CAPEX (domestic interconnection)", "CAPEX (domestic transmission)", "#83d1f7FF"),
    Variable("CAPEX (international interconnection)", "CAPEX (international transmission)", "#0252b5"),
]

# Variables drawn as outflows ---------------------------------

HOURLY_OUTFLOWS = [
    "Fin_Ene_Ele",
    "Sec_Ene_Ele_Sto_Cha_Gro_PHS",
    "Sec_Ene_Ele_Sto_Cha_Gro_LiB",
    "Sec_Ene_Ele_Own_Use_Ene_Sup_Hyd",
    "Sec_Ene_Ele_Cur",
]
ANNUAL_OUTFLOWS = ["Sec_Ene_Ele_Trd_Los", "Sec_Ene_Ele_Cur", "Sec_Ene_Ele_Sto_Los"]

# Category collapses ------------------------------------------

PUMPED_HYDRO_AS_HYDRO = {"Sec_Ene_Ele_Sto_Dis_PHS": "Sec_Ene_Ele_Hyd"}

SMALL_SOURCES_AS_OTHER = {
    "Sec_Ene_Ele_Hyd": "other",
    "Sec_Ene_Ele_Geo": "other",
    "Sec_Ene_Ele_Nuc": "other",
}

HOURLY_TO_ROLE = {
    "Sec_Ene_Ele_Sto_Cha_Gro_LiB": "Charge",
    "Sec_Ene_Ele_Sto_Cha_Gro_PHS": "Charge",
    "Sec_Ene_Ele_Nuc": "Other",
    "Sec_Ene_Ele_Hyd": "Other",
    "Sec_Ene_Ele_Geo": "Other",
    "Sec_Ene_Ele_Coa": "Other",
    "Sec_Ene_Ele_Bio": "Other",
    "Sec_Ene_Ele_Gas": "Other",
    "Sec_Ene_Ele_Oil": "Other",
    "Sec_Ene_Ele_Sto_Dis_LiB": "Discharge",
    "Sec_Ene_Ele_Sto_Dis_PHS": "Discharge",
    "Sec_Ene_Ele_Own_Use_Ene_Sup_Hyd": "Charge",
    "Sec_Ene_Ele_Cur": "Curtailment",
    "Sec_Ene_Ele_inc_Cur_Win": "Wind",
    "Sec_Ene_Ele_inc_Cur_Solar": "Solar",
    "Sec_Ene_Ele_H2_FC": "Discharge",
    "Sec_Ene_Ele_H2_GT": "Discharge",
    "Trd_Sec_Ene_Ele": "Transmission",
}

WIND_AND_SOLAR = [
    "Sec_Ene_Ele_Solar_Cen",
    "Sec_Ene_Ele_Solar_Dec",
    "Sec_Ene_Ele_Win_Ons",
    "Sec_Ene_Ele_Win_Off",
]

SMALL_LINKS_AS_OTHER = {
    "JP-CB / JP-HR": "Other",
    "JP-HR / JP-KS": "Other",
    "JP-KS / JP-SK": "Other",
    "JP-CG / JP-SK": "Other",
    "JP-CG / JP-KY": "Other",
}

PREFECTURE_GROUPS = {
    "JP-HD": "Hokkaido",
    "JP-TH": "Tohoku",
    "JP-KT": "Kanto",
    "JP-CB": "Chubu",
    "JP-HR": "Hokuriku",
    "JP-KS": "Kansai",
    "JP-CG": "Chugoku",
    "JP-SK": "Shikoku",
    "JP-KY": "Kyushu",
}

# Code maps ---------------------------------------------------

GENERATOR_VARIABLE = {
    "PVC": "Cap_Ele_Solar_Cen",
    "PVD": "Cap_Ele_Solar_Dec",
    "WON": "Cap_Ele_Win_Ons",
    "WOF": "Cap_Ele_Win_Off",
    "HYD": "Cap_Ele_Hyd",
    "GEO": "Cap_Ele_Geo",
    "BMS": "Cap_Ele_Bio_wo_CCS",
    "BMS_CCS": "Cap_Ele_Bio_w_CCS",
    "COL": "Cap_Ele_Coa_wo_CCS",
    "COL_CCS": "Cap_Ele_Coa_w_CCS",
    "GAS": "Cap_Ele_Gas_wo_CCS",
    "GAS_CCS": "Cap_Ele_Gas_w_CCS",
    "OIL": "Cap_Ele_Oil",
    "NUC": "Cap_Ele_Nuc",
}

STORAGE_VARIABLE = {
    "LIBE": "Cap_Ele_Sto_LiB_Ene",
    "PHSE": "Cap_Ele_Sto_PHS_Ene",
    "H2SE": "Cap_Ele_Sto_H2S_Ene",
}

STORAGE_LABEL = {"Cap_Ele_Sto_LiB_Ene": "Li-ion battery", "Cap_Ele_Sto_PHS_Ene": "pumped hydro"}

GENERATOR_COST_CLASS = {
    "PVC": "CAPEX (solar)",
    "PVDC": "CAPEX (solar)",
    "PVDR": "CAPEX (solar)",
    "WNO": "CAPEX (wind)",
    "WNB": "CAPEX (wind)",
    "WNF": "CAPEX (wind)",
    "GEO": "CAPEX (other)",
    "BMS": "CAPEX (other)",
    "BMS_CCS": "CAPEX (other)",
    "PC": "CAPEX (fossil w/o CCS)",
    "SC": "CAPEX (fossil w/o CCS)",
    "IGCC": "CAPEX (fossil w/o CCS)",
    "ST": "CAPEX (fossil w/o CCS)",
    "OCGT": "CAPEX (fossil w/o CCS)",
    "CCGT": "CAPEX (fossil w/o CCS)",
    "CCGT_CCS": "CAPEX (fossil w/ CCS)",
    "OIL": "CAPEX (fossil w/o CCS)",
}

RENEWABLE_LABEL = {
    "PVC": "solar utility",
    "PVDC": "solar rooftop, commercial",
    "PVDR": "solar rooftop, residential",
    "WNO": "wind onshore",
    "WNB": "wind offshore, fixed bottom",
    "WNF": "wind offshore, floating",
}

# Name patterns, first match wins -----------------------------

COUNTRY_OF_NODE = [("JP-", "JPN"), ("CN-", "CHN"), ("KR", "KOR"), ("MN", "MNG")]
COUNTRY_OF_GDP_REGION = {"China": "CHN", "Japan": "JPN", "South Korea": "KOR", "Mongolia": "MNG"}

CAPACITY_CORRIDORS = [
    ("CN-", "CN-", "China domestic"),
    ("JP-", "JP-", "Japan domestic"),
    ("CN-", "MN-", "China/Mongolia"),
    ("CN-", "KR-", "China/Korea"),
    ("KR-", "JP-", "Korea/Japan"),
]
CAPACITY_CORRIDORS_SHORT = [
    ("CN-", "CN-", "CHN"),
    ("JP-", "JP-", "JPN"),
    ("CN-", "MN-", "CHN-MNG"),
    ("CN-", "KR-", "CHN-KOR"),
    ("KR-", "JP-", "KOR-JPN"),
]
FLOW_CORRIDORS = [
    ("CN-", "MN", "China/Mongolia"),
    ("CN-", "KR", "China/Korea"),
    ("KR", "JP-", "Korea/Japan"),
]
CORRIDOR_ORDER = ["China/Mongolia", "China/Korea", "Korea/Japan", "China domestic", "Japan domestic"]

ASSET_OF_BUSES = [
    ("-AC$", "-DC$", "Cap_Ele_Sto_LiB_Pow"),
    ("-AC$", "-H2$", "Cap_Hyd_Ele"),
    ("-AC$", "-PHS$", "Cap_Ele_Sto_PHS_Pow"),
    ("-H2-GT$", "-AC$", "Cap_Ele_H2_GT"),
    ("-H2-FC$", "-AC$", "Cap_Ele_H2_FC"),
    ("-H2$", "-H2S$", "Cap_Hyd_Sto_H2S_Pow"),
    ("-AC$", "-AC2$", "Cap_Ele_Dis"),
]

AC_LINK = ".*-AC_.*-AC$"
LINK_ORIGIN = "(.*?)-AC_(.*?)-AC"
BUS_SUFFIX = "-AC$|-DC$|-H2$|-PHS$|-AC2$"
BATTERY_LINK = ".*-AC_.*-DC$"
HYDROGEN_LINK = ".*-AC_.*-H2$"
OTHER_LINK = ".*-AC_.*-AC2$|.*-AC_.*-PHS$"

SCENARIO_GRID_LABEL = {"NEAG": "w/ grid", "default": "w/o grid"}
HEADLINE_CODE = {"w/o grid": "w/o grid", "w/ grid": "2040", "w/ grid (2030)": "2030", "w/ grid (2035)": "2035"}

# Numbers -----------------------------------------------------

H2_TO_ELECTRICITY = 0.68
DISCOUNT_RATE = 0.05
DISCOUNT_BASE_YEAR = 2020
GDP_UNIT = 1e9
GDP_DEFLATOR = 91.9 / 102.9
SYMBOL_DIVISOR = 160000000
SYMBOL_SHIFT = 0.1
