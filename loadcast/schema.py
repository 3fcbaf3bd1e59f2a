"""Column contract, constants and feature groups shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column names of the public input data and of the model dataset ---
SUB = "id_subsistema"
SUB_NAME = "nom_subsistema"
DAY = "din_instante"
LOAD = "val_cargaenergiamwmed"
STATION = "estacao"
LEVEL_INPUT = "industrial_mwmed"
NATIONAL = "SIN"

SUBSYSTEM_NAMES = {
    "N": "Norte",
    "NE": "Nordeste",
    "S": "Sul",
    "SE": "Sudeste/Centro-Oeste",
}
REGION_NAMES = {**SUBSYSTEM_NAMES, NATIONAL: "SIN (nacional)"}
BOTTOM_UP_NAME = "SIN (soma dos 4)"

STATION_REGION_TO_SUB = {"N": "N", "NE": "NE", "S": "S", "SE": "SE", "CO": "SE"}

SENSOR_LIMITS = {
    "temp": (-15.0, 55.0),
    "umid": (1.0, 100.0),
    "rad": (0.0, 6000.0),
    "vento": (0.0, 60.0),
}
SENSOR_MISSING_CODES = ("", "-9999", "-9999.0")
SENSORS = ["temp", "umid", "rad", "vento", "precip"]
SENSOR_HEADER_PREFIXES = {
    "TEMPERATURA DO AR": "temp",
    "UMIDADE RELATIVA DO AR": "umid",
    "RADIACAO GLOBAL": "rad",
    "VENTO, VELOCIDADE": "vento",
    "PRECIPITACAO TOTAL": "precip",
}

COOLING_BASE = 22.0
HEATING_BASE = 18.0
HOT_HOUR = 26.0
MIN_READINGS = 18
PUBLICATION_LAG_MONTHS = 2
CLIMATOLOGY_WINDOW = 15
SEASON_HALF_WIDTH = 10
HOURS_PER_DAY = 24
SEED_DAYS = 7
HISTOGRAM_BINS = 22
RUN_UP_DAYS = 400

CLIMATE_INPUTS = ["temp_mean", "temp_max", "temp_min", "umid_mean", "umid_min",
                  "rad_sum", "vento_mean", "precip_sum"]
CLIMATE_ASKED = ["temp_mean", "temp_max", "temp_min", "umid_mean"]
DEGREE_COLUMNS = ["graus_refrig", "graus_aquec", "horas_acima_26"]
CLIMATE_DAILY = CLIMATE_INPUTS + DEGREE_COLUMNS

CALENDAR = ["mes", "dia_semana", "trimestre", "is_feriado", "is_fds",
            "is_vespera_feriado", "dia_ano_sen", "dia_ano_cos"]
CLIMATE = CLIMATE_DAILY + ["graus_refrig_med3", "temp_mean_ontem", "amplitude_termica"]
INDUSTRIAL = ["industrial_mwmed", "industrial_var_anual"]
AUTOREGRESSIVE = ["carga_ontem", "carga_lag7", "media_7d"]
FEATURE_GROUPS = {"clima": CLIMATE, "industrial": INDUSTRIAL,
                  "calendario": CALENDAR, "autoregressivo": AUTOREGRESSIVE}
ADDITIVE = [LOAD, "industrial_mwmed", "n_estacoes"]

CLASS_BLIND = "sem carga observada"
CLASS_SIGHTED = "com carga observada"
BASELINE_CLASS = {"media_treino": CLASS_BLIND, "climatologia": CLASS_BLIND,
                  "persistencia": CLASS_SIGHTED, "semana_anterior": CLASS_SIGHTED}
MODE_CLASS = {"climatico": CLASS_BLIND, "climatico (soma dos 4)": CLASS_BLIND,
              "delta_recursivo": CLASS_BLIND, "delta_recursivo (soma dos 4)": CLASS_BLIND,
              "delta_d1": CLASS_SIGHTED}
BASELINE_PREFIX = "[baseline] "
# --- end of fixed values ---

SUBSYSTEMS = list(SUBSYSTEM_NAMES)
REGIONS = list(REGION_NAMES)

LOAD_SCHEMA = T.StructType([
    T.StructField(SUB, T.StringType()),
    T.StructField(SUB_NAME, T.StringType()),
    T.StructField(DAY, T.StringType()),
    T.StructField(LOAD, T.DoubleType()),
])


def mode_features(mode: str, columns: list[str]) -> list[str]:
    """Feature columns a mode may read, restricted to those that exist.

    Only the autoregressive group reads observed load, so the climatic mode leaves it out.
    """
    allowed = {
        "climatico": CALENDAR + CLIMATE + INDUSTRIAL,
        "delta_d1": CALENDAR + CLIMATE + INDUSTRIAL + AUTOREGRESSIVE,
        "recursivo": CALENDAR + CLIMATE + INDUSTRIAL + AUTOREGRESSIVE,
    }
    if mode not in allowed:
        raise ValueError(f"unknown mode: {mode}")
    present = set(columns)
    return [c for c in allowed[mode] if c in present]
