"""DuckDB SQL for every query that SQL can express, written from the operators' definitions.

Shared table expressions are assembled as text; each oracle is one self-contained statement.
"""

from __future__ import annotations

SUBS = "('N','NE','S','SE')"
SUB_OF_REGION = ("CASE r_name WHEN 'AFRICA' THEN 'N' WHEN 'ASIA' THEN 'NE' "
                 "WHEN 'EUROPE' THEN 'S' ELSE 'SE' END")
CLIMATE = ["temp_mean", "temp_max", "temp_min", "umid_mean", "umid_min", "rad_sum", "vento_mean",
           "precip_sum"]
DEGREES = ["graus_refrig", "graus_aquec", "horas_acima_26"]
KEY = "id_subsistema, din_instante"
LOAD = "val_cargaenergiamwmed"
BY_SUB = "PARTITION BY id_subsistema ORDER BY din_instante"
TRAIN, TEST = 1999, 2000


def r(names: str | list[str], digits: int = 6) -> str:
    """Select list that rounds columns; adding zero turns a negative zero into zero."""
    names = names.split() if isinstance(names, str) else names
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def each(template: str, names: list[str]) -> str:
    return ", ".join(template.format(c=c) for c in names)


def filled(column: str, order: str = BY_SUB) -> str:
    """Last known value, else the next known one."""
    return (f"coalesce(last_value({column} IGNORE NULLS) OVER ({order} "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({column} IGNORE NULLS) OVER ({order} "
            f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


def station_stats(source: str, keys: str, minimum: int) -> str:
    return f"""
SELECT {keys}, din_instante, avg(temp) AS temp_mean, max(temp) AS temp_max, min(temp) AS temp_min,
       avg(umid) AS umid_mean, min(umid) AS umid_min, coalesce(sum(rad), 0) AS rad_sum,
       avg(vento) AS vento_mean, coalesce(sum(precip), 0) AS precip_sum,
       CAST(count(*) FILTER (WHERE temp > 26) AS DOUBLE) AS horas_acima_26,
       CASE WHEN count(temp) > 0 THEN greatest(0.0, avg(temp) - 22) END AS graus_refrig,
       CASE WHEN count(temp) > 0 THEN greatest(0.0, 18 - avg(temp)) END AS graus_aquec
FROM {source} GROUP BY {keys}, din_instante HAVING count(temp) >= {minimum}"""


def regional(source: str) -> str:
    return f"""
SELECT din_instante, id_subsistema, {each('avg({c}) AS {c}', CLIMATE + DEGREES)},
       CAST(count(DISTINCT estacao) AS DOUBLE) AS n_estacoes
FROM {source} GROUP BY din_instante, id_subsistema"""


def easter_fridays() -> str:
    # Good Fridays of the years the test tables span
    days = ["1995-04-14", "1996-04-05", "1997-03-28", "1998-04-10", "1999-04-02", "2000-04-21",
            "2001-04-13", "2002-03-29"]
    return ", ".join(f"DATE '{d}'" for d in days)


def holiday(day: str) -> str:
    return (f"(strftime({day}, '%m-%d') IN ('01-01','04-21','05-01','09-07','10-12','11-02',"
            f"'11-15','12-25') OR {day} IN ({easter_fridays()}))")


CALENDAR_COLUMNS = f"""
CAST(month(din_instante) AS INTEGER) AS mes, CAST(isodow(din_instante) - 1 AS INTEGER) AS dia_semana,
CAST(quarter(din_instante) AS INTEGER) AS trimestre, CAST(year(din_instante) AS INTEGER) AS ano,
CAST({holiday('din_instante')} AS INTEGER) AS is_feriado,
CAST({holiday('CAST(din_instante + INTERVAL 1 DAY AS DATE)')} AS INTEGER) AS is_vespera_feriado,
CAST(isodow(din_instante) >= 6 AS INTEGER) AS is_fds,
sin(2 * pi() * dayofyear(din_instante) / 365.25) AS dia_ano_sen,
cos(2 * pi() * dayofyear(din_instante) / 365.25) AS dia_ano_cos"""

HOURS_ABOVE = ("24 * (pi() - 2 * asin(greatest(-1.0, least(1.0, (26 - temp_mean) / "
               "greatest((temp_max - temp_min) / 2, 0.01))))) / (2 * pi())")

# table name -> (tables it needs, text)
TABLES: dict[str, tuple[list[str], str]] = {}


def table(name: str, needs: str, text: str) -> None:
    TABLES[name] = (needs.split(), text.strip())


table("carga", "", f"""
SELECT {SUB_OF_REGION} AS id_subsistema, CAST(o_orderdate AS DATE) AS din_instante,
       CAST(sum(CAST(round(o_totalprice / 100) AS BIGINT)) AS DOUBLE) AS {LOAD}
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")

table("item", "", f"""
SELECT l_suppkey AS estacao, {SUB_OF_REGION} AS id_subsistema, CAST(l_shipdate AS DATE) AS din_instante,
       15 + l_quantity * CAST('0.5772156649015329' AS DOUBLE) AS temp, 40 + round(l_discount * 100) * CAST('4.71238898038469' AS DOUBLE) AS umid,
       round(l_extendedprice / 100) AS rad, round(l_tax * 100) * CAST('0.915965594177219' AS DOUBLE) AS vento,
       CASE WHEN l_returnflag = 'R' THEN l_quantity END AS precip,
       CAST(round(l_extendedprice) AS BIGINT) AS valor
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""")

table("item_dia", "item", station_stats("item", "estacao, id_subsistema", 1))
table("clima", "item_dia", regional("item_dia"))

table("mensal", "item", """
SELECT CAST(year(din_instante) AS INTEGER) AS ano, CAST(month(din_instante) AS INTEGER) AS mes,
       id_subsistema, CAST(sum(valor) AS DOUBLE) AS industrial_mwh
FROM item GROUP BY 1, 2, 3""")

table("leitura", "", """
SELECT event_id, CAST(user_id % 12 AS INTEGER) AS estacao, CAST(ts AS DATE) AS din_instante,
       event_type AS arquivo,
       CASE WHEN (user_id % 12) % 5 = 0 THEN 'N' WHEN (user_id % 12) % 5 = 1 THEN 'NE'
            WHEN (user_id % 12) % 5 = 2 THEN 'S' ELSE 'SE' END AS id_subsistema,
       CASE WHEN value / 2 BETWEEN -15 AND 55 THEN value / 2 END AS temp,
       CASE WHEN k BETWEEN 1 AND 100 THEN k END AS umid,
       CASE WHEN value * 10 BETWEEN 0 AND 6000 THEN value * 10 END AS rad,
       CASE WHEN value / 8 BETWEEN 0 AND 60 THEN value / 8 END AS vento,
       CASE WHEN event_type = 'error' THEN value END AS precip
FROM (SELECT * EXCLUDE (value), round(value) AS value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k
      FROM events)""")
table("leitura_dia", "leitura", station_stats("leitura", "estacao, id_subsistema", 18))

table("limites", "carga", "SELECT min(din_instante) AS lo, max(din_instante) AS hi FROM carga")
table("limites_uso", "carga", f"""
SELECT CAST(min(din_instante) - INTERVAL 400 DAY AS DATE) AS lo, max(din_instante) AS hi
FROM carga WHERE year(din_instante) = {TEST}""")
table("ancora", "mensal", """
SELECT id_subsistema, CAST(make_date(ano, mes, 15) + INTERVAL 2 MONTH AS DATE) AS a,
       industrial_mwh / (24 * day(last_day(make_date(ano, mes, 15)))) AS v FROM mensal""")


def interpolation(suffix: str, bounds: str) -> None:
    table(f"grade{suffix}", f"mensal {bounds}", f"""
SELECT id_subsistema, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS din_instante
FROM (SELECT DISTINCT id_subsistema FROM mensal), {bounds}""")
    table(f"antes{suffix}", f"grade{suffix} ancora", f"""
SELECT g.id_subsistema, g.din_instante, a AS a0, v AS v0 FROM grade{suffix} g ASOF LEFT JOIN ancora x
ON g.id_subsistema = x.id_subsistema AND g.din_instante >= x.a""")
    table(f"depois{suffix}", f"grade{suffix} ancora", f"""
SELECT g.id_subsistema, g.din_instante, a AS a1, v AS v1 FROM grade{suffix} g ASOF LEFT JOIN ancora x
ON g.id_subsistema = x.id_subsistema AND g.din_instante <= x.a""")
    table(f"nivel{suffix}", f"antes{suffix} depois{suffix}", f"""
SELECT {KEY}, CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR a0 = a1 THEN v0
              ELSE v0 + (v1 - v0) * (din_instante - a0) / (a1 - a0) END AS industrial_mwmed
FROM antes{suffix} JOIN depois{suffix} USING ({KEY})""")
    table(f"nivel5{suffix}", f"nivel{suffix}", f"""
SELECT {KEY}, industrial_mwmed FROM nivel{suffix} UNION ALL
SELECT 'SIN', din_instante, sum(industrial_mwmed) FROM nivel{suffix} GROUP BY din_instante""")
    table(f"industrial{suffix}", f"nivel5{suffix}", f"""
SELECT *, coalesce((industrial_mwmed / nullif(lag(industrial_mwmed, 365) OVER ({BY_SUB}), 0) - 1) * 100, 0)
       AS industrial_var_anual FROM nivel5{suffix}""")


interpolation("", "limites")
interpolation("_uso", "limites_uso")

table("painel", "carga clima industrial", f"""
SELECT * FROM carga LEFT JOIN clima USING ({KEY}) LEFT JOIN industrial USING ({KEY})""")
table("pesos", "carga", f"""
SELECT id_subsistema, m / sum(m) OVER () AS peso FROM
(SELECT id_subsistema, avg({LOAD}) AS m FROM carga WHERE year(din_instante) = {TRAIN} GROUP BY 1)""")

WEIGHTED = CLIMATE + DEGREES + ["industrial_var_anual"]
table("nacional", "painel pesos", f"""
SELECT 'SIN' AS id_subsistema, din_instante, sum({LOAD}) AS {LOAD},
       coalesce(sum(industrial_mwmed), 0) AS industrial_mwmed, coalesce(sum(n_estacoes), 0) AS n_estacoes,
       {each('CASE WHEN count({c}) > 0 THEN sum({c} * peso) / sum(peso) END AS {c}', WEIGHTED)}
FROM painel JOIN pesos USING (id_subsistema)
GROUP BY din_instante HAVING count(DISTINCT id_subsistema) = 4""")
table("base5", "painel nacional", "SELECT * FROM painel UNION ALL BY NAME SELECT * FROM nacional")
table("conjunto", "base5", f"""
SELECT *, {CALENDAR_COLUMNS}, temp_max - temp_min AS amplitude_termica,
       avg(graus_refrig) OVER ({BY_SUB} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS graus_refrig_med3,
       lag(temp_mean) OVER ({BY_SUB}) AS temp_mean_ontem,
       lag({LOAD}, 1) OVER ({BY_SUB}) AS carga_ontem, lag({LOAD}, 7) OVER ({BY_SUB}) AS carga_lag7,
       CASE WHEN count({LOAD}) OVER ({BY_SUB} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) = 7 THEN
            avg({LOAD}) OVER ({BY_SUB} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS media_7d
FROM base5""")
table("treino", "conjunto", f"SELECT * FROM conjunto WHERE ano = {TRAIN}")
table("teste", "conjunto", f"SELECT * FROM conjunto WHERE ano = {TEST}")

table("medianas", "conjunto",
      f"SELECT id_subsistema, {each('median({c}) AS {c}', CLIMATE)} FROM conjunto GROUP BY 1")
table("normal_bruta", "conjunto", f"""
SELECT id_subsistema, CAST(dayofyear(din_instante) AS INTEGER) AS dia_ano,
       {each('median({c}) AS {c}', CLIMATE)} FROM conjunto GROUP BY 1, 2""")
table("normal_tripla", "normal_bruta", f"""
SELECT id_subsistema, dia_ano, copia, {each('median({c}) OVER w AS {c}', CLIMATE)}
FROM normal_bruta, (VALUES (0), (1), (2)) t(copia)
WINDOW w AS (PARTITION BY id_subsistema ORDER BY copia, dia_ano ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)""")
table("normal", "normal_tripla", "SELECT * EXCLUDE (copia) FROM normal_tripla WHERE copia = 1")

table("enviado_estacao", "item_dia", f"""
SELECT id_subsistema, din_instante, estacao, umid_mean,
       CASE WHEN day(din_instante) % 5 <> 0 THEN temp_mean END AS temp_mean
FROM item_dia""")
table("enviado", "enviado_estacao", f"""
SELECT {KEY}, temp_mean AS u_temp, umid_mean AS u_umid FROM enviado_estacao
QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY estacao DESC) = 1""")


def completed(suffix: str, regions: str, first: str, last: str, origin: str) -> None:
    table(f"cheio{suffix}", f"normal {regions}", f"""
SELECT id_subsistema, din_instante, {each(filled('{c}') + ' AS {c}', CLIMATE)}
FROM (SELECT id_subsistema, CAST(unnest(generate_series({first}, {last}, INTERVAL 1 DAY)) AS DATE) AS din_instante
      FROM (SELECT DISTINCT id_subsistema FROM {regions})) g
LEFT JOIN normal n ON n.id_subsistema = g.id_subsistema AND n.dia_ano = dayofyear(g.din_instante)"""
          .replace("SELECT id_subsistema, din_instante, coalesce", "SELECT g.id_subsistema, din_instante, coalesce")
          .replace("PARTITION BY id_subsistema", "PARTITION BY g.id_subsistema"))
    table(f"periodo{suffix}", f"cheio{suffix} enviado", f"""
SELECT {KEY}, coalesce(u_temp, temp_mean) AS temp_mean, temp_max, temp_min,
       coalesce(u_umid, umid_mean) AS umid_mean, umid_min, rad_sum, vento_mean, precip_sum,
       {origin} AS origem
FROM cheio{suffix} LEFT JOIN (SELECT *, TRUE AS veio FROM enviado) u USING ({KEY})""")


FROM_FILE = "CASE WHEN veio THEN 'arquivo' ELSE 'climatologia' END"
completed("_lote", "enviado", "(SELECT min(din_instante) FROM enviado)",
          "(SELECT make_date(year(max(din_instante)), 12, 31) FROM enviado)", FROM_FILE)
# a region without supplied rows is seeded with one empty row, which counts as supplied
completed("_ano", "conjunto", f"DATE '{TEST}-01-01'", f"DATE '{TEST}-12-31'", f"""
CASE WHEN veio OR (din_instante = DATE '{TEST}-01-01' AND id_subsistema NOT IN
(SELECT id_subsistema FROM enviado)) THEN 'arquivo' ELSE 'climatologia' END""")

table("usuario", "", """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 10 = 9 THEN 'Região Única ' || o_orderpriority ELSE
  list_extract(['Norte',' NORDESTE ','sul','Sudeste/Centro-Oeste','Centro-Oeste','SIN','Brasil','ne',
                'Sudeste  e Centro-Oeste'], CAST(o_orderkey % 10 + 1 AS INTEGER)) END AS regiao,
  list_extract(['N','NE','S','SE','SE','SIN','SIN','NE','SE'], CAST(o_orderkey % 10 + 1 AS INTEGER)) AS id_subsistema,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS din_instante,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) / 100 END AS temp_mean
FROM orders""")
table("aceito", "usuario", """
SELECT o_orderkey, id_subsistema, din_instante, temp_mean FROM usuario
WHERE id_subsistema IS NOT NULL AND din_instante IS NOT NULL""")

# level model: least squares on the filled industrial level
table("treino_nivel", "treino", f"SELECT id_subsistema, {LOAD} AS y, {filled('industrial_mwmed')} AS x FROM treino")
table("ajuste", "treino_nivel", """
SELECT id_subsistema, coalesce(regr_slope(y, x), 0) AS inclinacao,
       CASE WHEN regr_slope(y, x) IS NULL THEN avg(y) ELSE regr_intercept(y, x) END AS intercepto,
       avg(y) AS media_treino, count(*) AS n_dias FROM treino_nivel GROUP BY 1""")
table("previsto", "teste ajuste", f"""
SELECT {KEY}, {LOAD} AS y, intercepto + inclinacao * coalesce(industrial_mwmed, 0) AS p, temp_mean,
       industrial_mwmed FROM teste JOIN ajuste USING (id_subsistema)""")
NAME = ("CASE id_subsistema WHEN 'N' THEN 'Norte' WHEN 'NE' THEN 'Nordeste' WHEN 'S' THEN 'Sul' "
        "WHEN 'SE' THEN 'Sudeste/Centro-Oeste' ELSE 'SIN (nacional)' END")
table("previsao", "previsto", f"""
SELECT {KEY}, {NAME} AS regiao, p AS nivel_industrial, temp_mean - 20 AS resposta_climatica,
       p AS previsao_mwmed, CASE WHEN temp_mean IS NULL THEN 'climatologia' ELSE 'arquivo' END AS origem
FROM previsto""")
table("resumo", "previsao", """
SELECT regiao, id_subsistema, count(*) AS dias, avg(previsao_mwmed) AS mwmed_medio,
       min(previsao_mwmed) AS mwmed_min, max(previsao_mwmed) AS mwmed_max,
       sum(previsao_mwmed) * 24 / 1e6 AS energia_TWh,
       avg(previsao_mwmed) / max(previsao_mwmed) AS fator_carga, min(din_instante) AS de, max(din_instante) AS ate,
       avg(nivel_industrial) AS nivel_medio, avg(resposta_climatica) AS resposta_climatica_media,
       count(*) FILTER (WHERE origem = 'arquivo') AS dias_do_arquivo,
       count(*) FILTER (WHERE origem <> 'arquivo') AS dias_estimados
FROM previsao GROUP BY 1, 2""")
table("real_ano", "teste", f"SELECT id_subsistema, avg({LOAD}) AS real_mwmed FROM teste GROUP BY 1")
table("confronto", "resumo real_ano", """
SELECT regiao, id_subsistema, mwmed_medio, real_mwmed, (mwmed_medio / real_mwmed - 1) * 100 AS erro_pct
FROM resumo JOIN real_ano USING (id_subsistema)""")

table("bases", "treino teste", f"""
SELECT t.id_subsistema, t.din_instante, t.{LOAD}, m.media_treino, t.carga_ontem AS persistencia,
       t.carga_lag7 AS semana_anterior,
       {filled('perfil', 'PARTITION BY t.id_subsistema ORDER BY t.din_instante')} AS climatologia
FROM teste t
LEFT JOIN (SELECT id_subsistema, avg({LOAD}) AS media_treino FROM treino GROUP BY 1) m
  ON m.id_subsistema = t.id_subsistema
LEFT JOIN (SELECT id_subsistema, dayofyear(din_instante) AS doy, avg({LOAD}) AS perfil FROM treino GROUP BY 1, 2) c
  ON c.id_subsistema = t.id_subsistema AND c.doy = dayofyear(t.din_instante)""")
table("soma4", "previsto", f"""
SELECT 'SIN' AS id_subsistema, din_instante, max(y) FILTER (WHERE id_subsistema = 'SIN') AS y,
       sum(p) FILTER (WHERE id_subsistema IN {SUBS}) AS p
FROM previsto GROUP BY din_instante HAVING count(DISTINCT id_subsistema) FILTER (WHERE id_subsistema IN {SUBS}) = 4""")
table("pares", "bases previsto soma4", f"""
SELECT id_subsistema, '[baseline] media_treino' AS modo, 'sem carga observada' AS classe, {LOAD} AS y, media_treino AS p FROM bases
UNION ALL SELECT id_subsistema, '[baseline] climatologia', 'sem carga observada', {LOAD}, climatologia FROM bases
UNION ALL SELECT id_subsistema, '[baseline] persistencia', 'com carga observada', {LOAD}, persistencia FROM bases WHERE persistencia IS NOT NULL
UNION ALL SELECT id_subsistema, '[baseline] semana_anterior', 'com carga observada', {LOAD}, semana_anterior FROM bases WHERE semana_anterior IS NOT NULL
UNION ALL SELECT id_subsistema, 'climatico', 'sem carga observada', y, p FROM previsto
UNION ALL SELECT id_subsistema, 'climatico (soma dos 4)', 'sem carga observada', y, p FROM soma4""")
METRICS = ("avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, "
           "avg(abs((y - p) / nullif(y, 0))) * 100 AS mape, "
           "1 - sum((y - p) * (y - p)) / nullif(regr_syy(y, y), 0) AS r2, count(*) AS n")
table("notas", "pares", f"""
SELECT id_subsistema, modo, classe, {METRICS} FROM pares
WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2, 3""")
table("melhor", "notas", """
SELECT id_subsistema, classe, min(mae) AS ref FROM notas WHERE modo LIKE '[baseline]%' GROUP BY 1, 2""")
table("placar", "notas melhor", """
SELECT notas.*, CASE WHEN modo NOT LIKE '[baseline]%' THEN (1 - mae / nullif(ref, 0)) * 100 END AS ganho_pct
FROM notas LEFT JOIN melhor USING (id_subsistema, classe)""")


FEATURES = (["mes", "dia_semana", "trimestre", "is_feriado", "is_fds", "is_vespera_feriado", "dia_ano_sen", "dia_ano_cos"]
            + CLIMATE + DEGREES + ["graus_refrig_med3", "temp_mean_ontem", "amplitude_termica", "industrial_mwmed",
                                   "industrial_var_anual", "carga_ontem", "carga_lag7", "media_7d"])
table("celulas", "teste", f"""
SELECT id_subsistema, din_instante, coluna, valor FROM
(SELECT {KEY}, {each('CAST({c} AS DOUBLE) AS {c}', FEATURES)} FROM teste)
UNPIVOT INCLUDE NULLS (valor FOR coluna IN ({', '.join(FEATURES)}))""")
# every column permuted inside each region: the value of the row whose hash rank equals the day rank
table("lugares", "celulas", """
SELECT *, row_number() OVER (PARTITION BY semente, coluna, id_subsistema ORDER BY din_instante) AS dia,
       row_number() OVER (PARTITION BY semente, coluna, id_subsistema ORDER BY md5(
       semente || '|' || coluna || '|' || id_subsistema || '|' || CAST(din_instante AS VARCHAR))) AS bilhete
FROM celulas, (SELECT CAST(range AS INTEGER) AS semente FROM range(8))""")
table("sorteio", "lugares", """
SELECT a.semente, a.coluna, a.id_subsistema, a.din_instante, b.valor FROM lugares a JOIN lugares b
ON a.semente = b.semente AND a.coluna = b.coluna AND a.id_subsistema = b.id_subsistema AND a.dia = b.bilhete""")
table("dano", "previsto ajuste sorteio", f"""
SELECT semente, p.id_subsistema, avg(abs(p - y)) AS base,
       avg(abs(intercepto + inclinacao * coalesce(valor, 0) - y)) AS emb
FROM previsto p JOIN sorteio USING ({KEY}) JOIN ajuste USING (id_subsistema)
WHERE coluna = 'industrial_mwmed' GROUP BY 1, 2""")

table("pares_estacao", "teste conjunto", f"""
SELECT t.id_subsistema, t.dia_ano, h.{LOAD} AS y, h.temp_mean
FROM (SELECT DISTINCT id_subsistema, CAST(dayofyear(din_instante) AS INTEGER) AS dia_ano FROM teste) t
JOIN conjunto h ON h.id_subsistema = t.id_subsistema AND abs(dayofyear(h.din_instante) - t.dia_ano) <= 10""")
table("perto", "pares_estacao", """
SELECT id_subsistema, dia_ano, sum(y) / count(y) AS carga_media, min(y) AS carga_min, max(y) AS carga_max,
       sum(temp_mean) / count(temp_mean) AS temp_media, count(*) AS n_dias FROM pares_estacao GROUP BY 1, 2""")

# without any day near by, the whole history of the region stands in
table("contexto", "perto teste conjunto", f"""
SELECT * FROM perto UNION ALL BY NAME
SELECT t.id_subsistema, t.dia_ano, sum(h.{LOAD}) / count(h.{LOAD}) AS carga_media, min(h.{LOAD}) AS carga_min,
       max(h.{LOAD}) AS carga_max, sum(h.temp_mean) / count(h.temp_mean) AS temp_media,
       CASE WHEN count(h.din_instante) > 0 THEN count(h.din_instante) END AS n_dias
FROM (SELECT DISTINCT id_subsistema, CAST(dayofyear(din_instante) AS INTEGER) AS dia_ano FROM teste) t
LEFT JOIN conjunto h ON h.id_subsistema = t.id_subsistema
WHERE NOT EXISTS (SELECT 1 FROM perto p WHERE p.id_subsistema = t.id_subsistema AND p.dia_ano = t.dia_ano)
GROUP BY 1, 2""")

ORACLES: dict[str, str] = {}


def oracle(name: str, needs: str, select: str) -> None:
    """Prefix a statement with the table expressions it needs, dependencies first."""
    order: list[str] = []

    def visit(t: str) -> None:
        for dependency in TABLES[t][0]:
            visit(dependency)
        if t not in order:
            order.append(t)

    for t in needs.split():
        visit(t)
    head = ",\n".join(f"{t} AS ({TABLES[t][1]})" for t in order)
    ORACLES[name] = (f"WITH {head}\n" if head else "") + select.strip()


LEVEL3 = 3

oracle("load_scan", "carga", f"""
SELECT {KEY}, CASE id_subsistema WHEN 'N' THEN 'Norte' WHEN 'NE' THEN 'Nordeste' WHEN 'S' THEN 'Sul'
       ELSE 'Sudeste/Centro-Oeste' END AS nom_subsistema, {r(LOAD)} FROM carga""")
oracle("csv_br_format", "clima", f"""
SELECT {KEY}, replace(CAST(round(temp_mean, 4) AS VARCHAR), '.', ',') AS temp_mean,
       replace(CAST(rad_sum AS VARCHAR), '.', ',') AS rad_sum FROM clima""")
oracle("station_file_scan", "", """
SELECT CAST(user_id % 12 AS INTEGER) AS estacao, CAST(ts AS DATE) AS din_instante,
       list_extract(['N','NE','S','SE','CO'], CAST((user_id % 12) % 5 + 1 AS INTEGER)) AS regiao_estacao,
       round(value) / 2 AS temp, try_cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS DOUBLE) AS umid,
       round(value) * 10 AS rad, round(value) / 8 AS vento, CASE WHEN event_type = 'error' THEN round(value) END AS precip
FROM events""")
oracle("user_folder_scan", "aceito", f"SELECT {KEY}, {r('temp_mean')} FROM aceito")
oracle("user_file_rejects", "", """
SELECT pasta, motivo, true AS arquivos FROM (VALUES ('unknown_region', 'unknown_region'), ('bad_date', 'bad_date'),
  ('only-header', 'empty'), ('zero-bytes', 'empty'), ('narrow', 'dialect'), ('no-date', 'missing_column'),
  ('open-quote', 'quotes')) t(pasta, motivo)""")
oracle("normalize_label", "usuario", """
SELECT o_orderkey, upper(strip_accents(trim(regexp_replace(regiao, '\\s+', ' ', 'g')))) AS maiuscula,
       lower(strip_accents(trim(regexp_replace(regiao, '\\s+', ' ', 'g')))) AS minuscula FROM usuario""")
oracle("region_lookup", "usuario", "SELECT o_orderkey, id_subsistema FROM usuario")
oracle("region_rejects", "usuario", """
SELECT DISTINCT regiao AS rotulo FROM usuario WHERE id_subsistema IS NULL ORDER BY 1 LIMIT 5""")
oracle("reject_rows", "usuario", """
SELECT o_orderkey, regiao AS rotulo, CASE WHEN id_subsistema IS NULL THEN 'unknown_region' ELSE 'bad_date' END AS motivo
FROM usuario WHERE id_subsistema IS NULL OR din_instante IS NULL""")
oracle("alias_rename", "usuario", """
SELECT o_orderkey, regiao AS id_subsistema, CASE WHEN o_orderkey % 7 = 0 THEN '31/02/1999'
       WHEN o_orderkey % 2 = 0 THEN strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y')
       ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS din_instante
FROM usuario JOIN (SELECT o_orderkey, o_orderdate FROM orders) USING (o_orderkey)""")
oracle("reject_reasons", "usuario", """
SELECT CASE WHEN id_subsistema IS NULL THEN 'unknown_region' ELSE 'bad_date' END AS motivo, count(*) AS linhas
FROM usuario WHERE id_subsistema IS NULL OR din_instante IS NULL GROUP BY 1""")
oracle("user_dates", "usuario", "SELECT o_orderkey, din_instante FROM usuario")
oracle("user_numbers", "usuario", "SELECT o_orderkey, round(temp_mean, 6) + 0.0 AS temp_mean FROM usuario")
oracle("user_inputs", "aceito", f"SELECT o_orderkey, {KEY}, {r('temp_mean')} FROM aceito")

oracle("qc_readings", "leitura", f"SELECT event_id, {r('temp umid rad vento precip')} FROM leitura")
oracle("station_day_stats", "leitura_dia",
       f"SELECT estacao, {KEY}, {r(CLIMATE + DEGREES)} FROM leitura_dia")
table("leitura_arquivo", "leitura", station_stats("leitura", "arquivo, estacao, id_subsistema", 1))
oracle("dedup_keep_last", "leitura_arquivo", f"""
SELECT arquivo, estacao, {KEY}, {r(CLIMATE + DEGREES)} FROM leitura_arquivo
QUALIFY row_number() OVER (PARTITION BY estacao, din_instante ORDER BY arquivo DESC) = 1""")
table("leitura_regional", "leitura_dia", regional("leitura_dia"))
oracle("events_regional_climate", "leitura_regional",
       f"SELECT {KEY}, {r(CLIMATE + DEGREES + ['n_estacoes'])} FROM leitura_regional")
ORACLES["station_climate_job"] = ORACLES["events_regional_climate"]
oracle("lineitem_regional_climate", "clima",
       f"SELECT {KEY}, {r(CLIMATE + DEGREES + ['n_estacoes'])} FROM clima")
oracle("clamp_temps", "clima", f"""
SELECT {KEY}, round(greatest(temp_min + 0.5, temp_mean), 6) + 0.0 AS temp_max,
       round(least(temp_max - 0.5, temp_mean), 6) + 0.0 AS temp_min FROM clima""")
oracle("daily_hours_above", "clima", f"SELECT {KEY}, round({HOURS_ABOVE}, 6) + 0.0 AS horas FROM clima")

oracle("sheet_blocks", "mensal", f"SELECT ano, mes, id_subsistema, {r('industrial_mwh')} FROM mensal")
oracle("interp_daily", "nivel", f"SELECT {KEY}, {r('industrial_mwmed')} FROM nivel")
oracle("interp_step", "antes",
       f"SELECT {KEY}, round(v0, 6) + 0.0 AS industrial_mwmed FROM antes WHERE v0 IS NOT NULL")
oracle("interp_daily_national", "nivel5", f"SELECT {KEY}, {r('industrial_mwmed')} FROM nivel5")
oracle("annual_change", "industrial",
       f"SELECT {KEY}, {r('industrial_mwmed industrial_var_anual')} FROM industrial")
oracle("serving_industrial", "industrial_uso",
       f"SELECT {KEY}, {r('industrial_mwmed industrial_var_anual')} FROM industrial_uso")

oracle("panel_join", "painel", f"""
SELECT {KEY}, {r([LOAD, 'temp_mean', 'n_estacoes', 'industrial_mwmed', 'industrial_var_anual'])} FROM painel""")
oracle("missing_climate", "carga clima", f"""
SELECT id_subsistema, count(*) FILTER (WHERE temp_mean IS NULL) AS dias_sem_clima
FROM carga LEFT JOIN clima USING ({KEY}) GROUP BY 1""")
oracle("load_shares", "pesos", f"SELECT id_subsistema, {r('peso')} FROM pesos")
oracle("national_aggregate", "nacional", f"""
SELECT {KEY}, {r([LOAD, 'industrial_mwmed', 'n_estacoes'] + WEIGHTED)} FROM nacional""")
oracle("load_lags", "carga", f"""
SELECT {KEY}, {r(LOAD)}, round(lag({LOAD}) OVER ({BY_SUB}), 6) + 0.0 AS carga_ontem,
       round(lag({LOAD}, 7) OVER ({BY_SUB}), 6) + 0.0 AS carga_lag7 FROM carga""")
table("dias_todos", "carga", """
SELECT id_subsistema, CAST(unnest(generate_series(min(din_instante), max(din_instante), INTERVAL 1 DAY)) AS DATE)
       AS din_instante FROM carga GROUP BY id_subsistema""")
oracle("calendar_lags", "dias_todos carga", f"""
SELECT g.id_subsistema, g.din_instante, round(c.{LOAD}, 6) + 0.0 AS {LOAD},
       round(d1.{LOAD}, 6) + 0.0 AS carga_ontem, round(d7.{LOAD}, 6) + 0.0 AS carga_lag7
FROM dias_todos g LEFT JOIN carga c USING ({KEY})
LEFT JOIN carga d1 ON d1.id_subsistema = g.id_subsistema AND d1.din_instante = g.din_instante - INTERVAL 1 DAY
LEFT JOIN carga d7 ON d7.id_subsistema = g.id_subsistema AND d7.din_instante = g.din_instante - INTERVAL 7 DAY""")
oracle("trailing_mean_7", "base5", f"""
SELECT {KEY}, {r(LOAD)}, CASE WHEN row_number() OVER ({BY_SUB}) > 7 THEN
       round((lag({LOAD}, 1) OVER ({BY_SUB}) + lag({LOAD}, 2) OVER ({BY_SUB}) + lag({LOAD}, 3) OVER ({BY_SUB})
       + lag({LOAD}, 4) OVER ({BY_SUB}) + lag({LOAD}, 5) OVER ({BY_SUB}) + lag({LOAD}, 6) OVER ({BY_SUB})
       + lag({LOAD}, 7) OVER ({BY_SUB})) / 7, 6) + 0.0 END AS media_7d
FROM base5 WHERE id_subsistema <> 'SIN'""")
oracle("thermal_inertia", "conjunto", f"""
SELECT {KEY}, {r('amplitude_termica graus_refrig_med3 temp_mean_ontem')} FROM conjunto WHERE id_subsistema <> 'SIN'""")
oracle("fill_both_ways", "dias_todos carga", f"""
SELECT {KEY}, round({filled(LOAD)}, 6) + 0.0 AS {LOAD} FROM dias_todos LEFT JOIN carga USING ({KEY})""")
oracle("carry_readings", "leitura", f"""
SELECT event_id, din_instante, estacao, round({filled('precip', 'PARTITION BY estacao ORDER BY din_instante, event_id')}, 6) + 0.0 AS precip
FROM leitura""")
oracle("reading_medians", "item", """
SELECT id_subsistema, sensor, round(median(valor), 6) + 0.0 AS mediana
FROM (UNPIVOT (SELECT id_subsistema, temp, umid, rad, vento, precip FROM item)
      ON temp, umid, rad, vento, precip INTO NAME sensor VALUE valor) GROUP BY 1, 2""")
oracle("calendar_columns", "", f"""
SELECT o_orderkey, din_instante, mes, dia_semana, trimestre, ano, is_feriado, is_vespera_feriado, is_fds,
       {r('dia_ano_sen dia_ano_cos')} FROM
(SELECT o_orderkey, din_instante, {CALENDAR_COLUMNS} FROM
 (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS din_instante FROM orders))""")
oracle("holiday_flags", "carga", f"""
SELECT din_instante, CAST({holiday('din_instante')} AS INTEGER) AS is_feriado,
       CAST({holiday('CAST(din_instante + INTERVAL 1 DAY AS DATE)')} AS INTEGER) AS is_vespera_feriado
FROM (SELECT DISTINCT din_instante FROM carga)""")
FLOATS = ([LOAD] + CLIMATE + DEGREES + ["n_estacoes", "industrial_mwmed", "industrial_var_anual", "dia_ano_sen",
          "dia_ano_cos", "amplitude_termica", "graus_refrig_med3", "temp_mean_ontem", "carga_ontem",
          "carga_lag7", "media_7d"])
INTS = "mes, dia_semana, trimestre, is_feriado, is_vespera_feriado, is_fds"
oracle("model_dataset", "conjunto", f"SELECT {KEY}, ano, {INTS}, {r(FLOATS)} FROM conjunto")
ORACLES["dataset_sink_scan"] = ORACLES["model_dataset"]
ORACLES["dataset_changed_years"] = ORACLES["model_dataset"]
table("limites_longos", "limites", "SELECT CAST(lo - INTERVAL 400 DAY AS DATE) AS lo, hi FROM limites")
interpolation("_longo", "limites_longos")
table("degrau", "antes_longo", f"""
SELECT {KEY}, v0 AS industrial_mwmed FROM antes_longo WHERE v0 IS NOT NULL UNION ALL
SELECT 'SIN', din_instante, sum(v0) FROM antes_longo WHERE v0 IS NOT NULL GROUP BY din_instante""")
table("degrau_var", "degrau", f"""
SELECT *, coalesce((industrial_mwmed / nullif(lag(industrial_mwmed, 365) OVER ({BY_SUB}), 0) - 1) * 100, 0)
       AS industrial_var_anual FROM degrau""")
# the national level is the sum over the subsystems that have a load that day: all four
oracle("model_dataset_strict", "carga degrau_var nacional", f"""
SELECT {KEY}, {r('industrial_mwmed industrial_var_anual')} FROM carga LEFT JOIN degrau_var USING ({KEY})
UNION ALL SELECT n.id_subsistema, n.din_instante, round(coalesce(d.industrial_mwmed, 0), 6) + 0.0,
       round(d.industrial_var_anual, 6) + 0.0
FROM nacional n LEFT JOIN degrau_var d ON d.id_subsistema = 'SIN' AND d.din_instante = n.din_instante""")
oracle("features_climatico", "conjunto", f"""
SELECT {KEY}, {INTS}, {r([c for c in FLOATS if c not in (LOAD, 'n_estacoes', 'carga_ontem', 'carga_lag7', 'media_7d')])}
FROM conjunto""")

oracle("region_medians", "medianas", f"SELECT id_subsistema, {r(CLIMATE)} FROM medianas")
oracle("climatology_raw", "normal_bruta", f"SELECT id_subsistema, dia_ano, {r(CLIMATE)} FROM normal_bruta")
oracle("climatology_smooth", "normal", f"SELECT id_subsistema, dia_ano, {r(CLIMATE)} FROM normal")
oracle("climatology_fallback", "normal", f"""
SELECT id_subsistema, dia_ano, {r(CLIMATE)} FROM normal WHERE id_subsistema <> 'SIN'
UNION ALL SELECT 'SIN', dia_ano, {each('round(median({c}), 6) + 0.0 AS {c}', CLIMATE)}
FROM normal WHERE id_subsistema <> 'SIN' GROUP BY dia_ano""")
oracle("daily_grid", "carga limites", """
SELECT id_subsistema, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS din_instante
FROM (SELECT DISTINCT id_subsistema FROM carga), limites""")
oracle("complete_period", "periodo_lote", f"SELECT {KEY}, {r(CLIMATE)}, origem FROM periodo_lote")
oracle("missing_regions", "conjunto enviado", """
SELECT DISTINCT id_subsistema FROM conjunto WHERE id_subsistema NOT IN (SELECT id_subsistema FROM enviado)""")
oracle("project_year_inputs", "periodo_ano", f"SELECT {KEY}, {r(CLIMATE)}, origem FROM periodo_ano")
completed("_normal", "conjunto", f"DATE '{TEST + 1}-01-01'", f"DATE '{TEST + 1}-12-31'", "'climatologia'")
oracle("normal_year_inputs", "cheio_normal", f"SELECT {KEY}, {r(CLIMATE)}, 'climatologia' AS origem FROM cheio_normal")
oracle("fill_region_median", "conjunto medianas", f"""
SELECT c.id_subsistema, c.din_instante, {each('round(coalesce(c.{c}, m.{c}), 6) + 0.0 AS {c}', CLIMATE)}
FROM conjunto c JOIN medianas m ON m.id_subsistema = c.id_subsistema""")

table("limites_pedido", "aceito", """
SELECT CAST(min(din_instante) - INTERVAL 400 DAY AS DATE) AS lo, max(din_instante) AS hi FROM aceito""")
interpolation("_pedido", "limites_pedido")
table("pedido", "aceito medianas", f"""
SELECT o_orderkey, a.id_subsistema, din_instante, coalesce(a.temp_mean / 10000, m.temp_mean) AS temp_mean,
       greatest(m.temp_max, coalesce(a.temp_mean / 10000, m.temp_mean)) AS temp_max,
       least(m.temp_min, coalesce(a.temp_mean / 10000, m.temp_mean)) AS temp_min,
       {each('m.{c}', CLIMATE[3:])}
FROM aceito a JOIN medianas m ON m.id_subsistema = a.id_subsistema""")
oracle("serving_features", "pedido industrial_pedido", f"""
SELECT o_orderkey, {KEY}, {r(CLIMATE)}, CAST({holiday('din_instante')} AS INTEGER) AS is_feriado,
       CAST(isodow(din_instante) - 1 AS INTEGER) AS dia_semana,
       round(greatest(0.0, temp_mean - 22), 6) + 0.0 AS graus_refrig,
       round(greatest(0.0, 18 - temp_mean), 6) + 0.0 AS graus_aquec,
       round({HOURS_ABOVE}, 6) + 0.0 AS horas_acima_26,
       round(temp_max - temp_min, 6) + 0.0 AS amplitude_termica,
       round(greatest(0.0, temp_mean - 22), 6) + 0.0 AS graus_refrig_med3,
       round(temp_mean, 6) + 0.0 AS temp_mean_ontem, {r('industrial_mwmed industrial_var_anual')}
FROM pedido LEFT JOIN industrial_pedido USING ({KEY})""")
oracle("observed_climate", "teste", f"SELECT {KEY}, {r(CLIMATE)} FROM teste")
oracle("temperature_sweep_inputs", "conjunto teste", f"""
SELECT id_subsistema, din_instante, passo, round(t, 6) + 0.0 AS temp_mean, round(t + amp / 2, 6) + 0.0 AS temp_max,
       round(t - amp / 2, 6) + 0.0 AS temp_min
FROM (SELECT *, lo + passo * (hi - lo) / 59 AS t FROM
      (SELECT id_subsistema, din_instante FROM teste)
      JOIN (SELECT id_subsistema, min(temp_mean) - 2 AS lo, max(temp_mean) + 2 AS hi,
                   median(temp_max - temp_min) AS amp FROM conjunto GROUP BY 1) USING (id_subsistema),
      (SELECT CAST(range AS INTEGER) AS passo FROM range(60)))""")

oracle("level_fit", "ajuste", f"""
SELECT id_subsistema, {r('inclinacao intercepto media_treino', LEVEL3)}, n_dias FROM ajuste""")
oracle("level_forecast", "previsao", f"""
SELECT {KEY}, regiao, {r('nivel_industrial resposta_climatica previsao_mwmed', LEVEL3)}, origem FROM previsao""")
oracle("period_summary", "resumo", f"""
SELECT regiao, id_subsistema, dias, {r('mwmed_medio mwmed_min mwmed_max energia_TWh fator_carga', LEVEL3)}, de, ate,
       {r('nivel_medio resposta_climatica_media', LEVEL3)}, dias_do_arquivo, dias_estimados FROM resumo""")
oracle("compare_observed", "previsto", f"""
SELECT {NAME} AS regiao, id_subsistema, count(*) AS dias_comparados, round(avg(p), 3) + 0.0 AS mwmed_previsto,
       round(avg(y), 3) + 0.0 AS mwmed_observado, round((avg(p) / avg(y) - 1) * 100, 3) + 0.0 AS erro_medio_pct,
       round(avg(abs(p - y)), 3) + 0.0 AS mae_diario,
       round(avg(abs(p - y) / nullif(y, 0)) * 100, 3) + 0.0 AS mape_diario_pct FROM previsto GROUP BY 1, 2""")
oracle("annual_observed", "real_ano", f"SELECT id_subsistema, {r('real_mwmed')} FROM real_ano")
oracle("annual_vs_observed", "confronto", f"""
SELECT regiao, id_subsistema, {r('mwmed_medio real_mwmed erro_pct', LEVEL3)} FROM confronto""")
oracle("bottom_up_annual", "confronto", f"""
SELECT regiao, id_subsistema, {r('mwmed_medio real_mwmed erro_pct', LEVEL3)} FROM confronto
UNION ALL SELECT 'SIN (soma dos 4)', 'SIN (soma dos 4)', round(s, 3) + 0.0, round(o, 3) + 0.0,
       round((s / o - 1) * 100, 3) + 0.0
FROM (SELECT sum(mwmed_medio) FILTER (WHERE id_subsistema <> 'SIN') AS s,
             max(real_mwmed) FILTER (WHERE id_subsistema = 'SIN') AS o, count(*) AS n FROM confronto) WHERE n = 5""")
oracle("coverage_summary", "conjunto", """
SELECT id_subsistema, count(*) AS linhas, count(DISTINCT din_instante) AS dias_distintos, min(din_instante) AS de,
       max(din_instante) AS ate, round(avg(temp_mean), 6) + 0.0 AS temp_media,
       round(avg(n_estacoes), 6) + 0.0 AS estacoes, round(avg(industrial_mwmed), 6) + 0.0 AS industrial
FROM conjunto GROUP BY 1""")
oracle("monthly_profile", "previsao", """
SELECT regiao, CAST(month(din_instante) AS INTEGER) AS mes, round(avg(previsao_mwmed), 3) + 0.0 AS previsao_media
FROM previsao GROUP BY 1, 2""")
oracle("season_context", "contexto", f"""
SELECT id_subsistema, dia_ano, {r('carga_media carga_min carga_max temp_media')}, n_dias FROM contexto""")
oracle("season_deviation", "previsao contexto", f"""
SELECT p.id_subsistema, p.din_instante, round(previsao_mwmed, 3) + 0.0 AS previsao_mwmed,
       round(previsao_mwmed - carga_media, 3) + 0.0 AS desvio,
       round(resposta_climatica / nullif(previsao_mwmed, 0) * 100, 3) + 0.0 AS parcela_resposta_pct
FROM previsao p LEFT JOIN contexto c ON c.id_subsistema = p.id_subsistema AND c.dia_ano = dayofyear(p.din_instante)""")
oracle("season_histogram", "pares_estacao", """
SELECT id_subsistema, dia_ano, CAST(least(22, floor(CASE WHEN hi > lo THEN (y - lo) / ((hi - lo) / 22) ELSE 11 END) + 1)
       AS INTEGER) AS faixa, count(*) AS dias
FROM (SELECT *, min(y) OVER w AS lo, max(y) OVER w AS hi FROM pares_estacao
      WINDOW w AS (PARTITION BY id_subsistema, dia_ano)) GROUP BY 1, 2, 3""")
oracle("sensitivity", "previsao", """
SELECT id_subsistema, round(max(previsao_mwmed) - min(previsao_mwmed), 3) + 0.0 AS variacao_mwmed,
       round((max(previsao_mwmed) - min(previsao_mwmed)) / avg(previsao_mwmed) * 100, 3) + 0.0 AS variacao_pct
FROM previsao GROUP BY 1""")
table("varredura", "conjunto teste", """
SELECT id_subsistema, din_instante, passo, lo + passo * (hi - lo) / 59 AS t FROM
      (SELECT id_subsistema, din_instante FROM teste)
      JOIN (SELECT id_subsistema, min(temp_mean) - 2 AS lo, max(temp_mean) + 2 AS hi FROM conjunto GROUP BY 1)
      USING (id_subsistema), (SELECT CAST(range AS INTEGER) AS passo FROM range(60))""")
oracle("sweep_sensitivity", "varredura previsto", f"""
SELECT {KEY}, round(max(f) - min(f), 3) + 0.0 AS variacao_mwmed,
       round((max(f) - min(f)) / avg(f) * 100, 3) + 0.0 AS variacao_pct
FROM (SELECT {KEY}, p + t - 20 AS f FROM varredura JOIN previsto USING ({KEY})) GROUP BY 1, 2""")
oracle("field_ranges", "conjunto", """
SELECT id_subsistema, campo, round(min(valor) - (max(valor) - min(valor)) * 0.25, 1) + 0.0 AS minimo,
       round(max(valor) + (max(valor) - min(valor)) * 0.25, 1) + 0.0 AS maximo,
       round(median(valor), 1) + 0.0 AS padrao
FROM (UNPIVOT (SELECT id_subsistema, temp_mean, temp_max, temp_min, umid_mean FROM conjunto)
      ON temp_mean, temp_max, temp_min, umid_mean INTO NAME campo VALUE valor) GROUP BY 1, 2""")
oracle("error_series", "previsto", f"""
SELECT {KEY}, round(y, 3) + 0.0 AS {LOAD}, round(p, 3) + 0.0 AS previsao, round(p - y, 3) + 0.0 AS erro FROM previsto""")

for _query, _column in (("baseline_mean", "media_treino"), ("baseline_climatology", "climatologia"),
                        ("baseline_persistence", "persistencia"), ("baseline_week", "semana_anterior")):
    oracle(_query, "bases", f"SELECT {KEY}, {r([LOAD, _column])} FROM bases")
oracle("forecast_metrics", "previsto", f"""
SELECT id_subsistema, {r('mae rmse mape r2', LEVEL3)}, n FROM
(SELECT id_subsistema, {METRICS} FROM previsto GROUP BY 1)""")
oracle("bottom_up_metrics", "soma4", f"""
SELECT id_subsistema, 'climatico (soma dos 4)' AS modo, {r('mae rmse mape r2', LEVEL3)}, n FROM
(SELECT id_subsistema, {METRICS} FROM soma4 GROUP BY 1)""")
oracle("score_sheet", "placar", f"""
SELECT id_subsistema, modo, classe, {r('mae rmse mape r2 ganho_pct', LEVEL3)}, n FROM placar""")
oracle("class_gain", "placar", f"""
SELECT id_subsistema, modo, classe, {r('ganho_pct', LEVEL3)} FROM placar WHERE ganho_pct IS NOT NULL""")
oracle("accuracy_pivot", "notas", """
SELECT id_subsistema, round(max(100 - mape) FILTER (WHERE modo = 'climatico'), 3) + 0.0 AS climatico,
       round(max(100 - mape) FILTER (WHERE modo = 'climatico (soma dos 4)'), 3) + 0.0 AS "climatico (soma dos 4)"
FROM notas GROUP BY 1""")
oracle("shuffle_column", "sorteio", f"""
SELECT {KEY}, {each("round(max(valor) FILTER (WHERE coluna = '{c}'), 6) + 0.0 AS {c}_emb", FEATURES)}
FROM sorteio WHERE semente = 0 GROUP BY 1, 2""")
oracle("contamination_standin", "dano", """
SELECT id_subsistema, grupo, round(base, 3) + 0.0 AS mae_base,
       round(CASE WHEN grupo = 'industrial' THEN emb ELSE base END, 3) + 0.0 AS mae_embaralhado,
       round(CASE WHEN grupo = 'industrial' THEN (emb / base - 1) * 100 ELSE 0 END, 3) + 0.0 AS piora_pct
FROM dano, (VALUES ('clima'), ('industrial'), ('calendario'), ('autoregressivo')) t(grupo) WHERE semente = 0""")
oracle("importance_standin", "dano", f"""
SELECT id_subsistema, coluna, round(g, 3) + 0.0 AS piora_mae,
       CAST(row_number() OVER (PARTITION BY id_subsistema ORDER BY g DESC, coluna) AS INTEGER) AS posicao
FROM (SELECT id_subsistema, coluna,
             CASE WHEN coluna = 'industrial_mwmed' THEN round(avg(emb) - avg(base), 6) ELSE 0.0 END AS g
      FROM dano, (SELECT unnest({FEATURES}) AS coluna) GROUP BY 1, 2)""")
oracle("recursive_standin", "teste", f"""
SELECT {KEY}, round(CASE WHEN pos <= 7 THEN {LOAD} ELSE s7 + pos - 7 END, 6) + 0.0 AS previsao
FROM (SELECT {KEY}, {LOAD}, row_number() OVER ({BY_SUB}) AS pos,
      nth_value({LOAD}, 7) OVER ({BY_SUB} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s7 FROM teste)""")
oracle("recursive_scenarios", "teste", f"""
SELECT {KEY}, CAST(cenario AS INTEGER) AS cenario, round(semente + (pos - 1) // 7 * cenario / 4, 6) + 0.0 AS previsao
FROM (SELECT {KEY}, pos, first_value({LOAD}) OVER (PARTITION BY id_subsistema, pos % 7 ORDER BY pos) AS semente
      FROM (SELECT {KEY}, {LOAD}, row_number() OVER ({BY_SUB}) AS pos FROM teste)), range(-20, 21) t(cenario)""")

# what holds of the tree models whatever they learn
oracle("climatic_parts", "previsto", f"SELECT {KEY}, round(p, 3) + 0.0 AS nivel_industrial, CAST(0 AS DOUBLE) AS resto FROM previsto")
oracle("delta_parts", "teste", f"""
SELECT {KEY}, round(carga_ontem, 3) + 0.0 AS carga_ontem, CAST(0 AS DOUBLE) AS resto FROM teste
WHERE carga_ontem IS NOT NULL AND carga_lag7 IS NOT NULL AND media_7d IS NOT NULL""")
oracle("recursive_seed", "teste", f"""
SELECT {KEY}, CASE WHEN row_number() OVER ({BY_SUB}) <= 7 THEN round({LOAD}, 3) + 0.0 END AS semente, TRUE AS previsto
FROM teste""")
PLACES = f"(VALUES ('climatico', {len(FEATURES) - 3}), ('delta_d1', {len(FEATURES)})) t(modo, n)"
oracle("importance_totals", "treino", f"""
SELECT id_subsistema, modo, CAST(1 AS DOUBLE) AS total, CAST(n AS BIGINT) AS atributos, CAST(n AS BIGINT) AS posicoes
FROM (SELECT DISTINCT id_subsistema FROM treino), {PLACES}""")
oracle("permutation_places", "teste", f"""
SELECT id_subsistema, modo, CAST(n AS BIGINT) AS colunas, CAST(n AS INTEGER) AS ultima
FROM (SELECT DISTINCT id_subsistema FROM teste), {PLACES}""")
oracle("contamination_blind", "teste", """
SELECT DISTINCT id_subsistema, 'autoregressivo' AS grupo, CAST(0 AS DOUBLE) AS piora_pct FROM teste""")
oracle("model_score_baselines", "placar", f"""
SELECT id_subsistema, modo, {r('mae rmse', LEVEL3)}, n FROM placar WHERE modo LIKE '[baseline]%'""")
oracle("project_year_days", "teste", f"""
SELECT {NAME} AS regiao, id_subsistema, CAST(366 AS BIGINT) AS dias, DATE '{TEST}-01-01' AS de, DATE '{TEST}-12-31' AS ate,
       count(*) AS dias_do_arquivo, 366 - count(*) AS dias_estimados FROM teste GROUP BY 1, 2""")
oracle("response_steps", "varredura", f"SELECT {KEY}, passo, round(t, 6) + 0.0 AS temp_mean FROM varredura")
oracle("input_positions", "aceito", f"""
SELECT o_orderkey, {KEY}, row_number() OVER (ORDER BY din_instante, o_orderkey) AS posicao FROM aceito""")
oracle("batch_parts", "aceito industrial_pedido ajuste", f"""
SELECT o_orderkey, {KEY}, row_number() OVER (ORDER BY o_orderkey) AS posicao,
       round(intercepto + inclinacao * coalesce(industrial_mwmed, 0), 3) + 0.0 AS nivel_industrial,
       CAST(0 AS DOUBLE) AS resto
FROM aceito LEFT JOIN industrial_pedido USING ({KEY}) JOIN ajuste USING (id_subsistema)""")
ORACLES["published_scores"] = ORACLES["score_sheet"]
oracle("model_registry", "treino", f"""
SELECT id_subsistema, modo, CAST({TEST} AS INTEGER) AS ano, CAST({TEST - 1} AS INTEGER) AS ano_treino, CAST(n AS INTEGER) AS atributos
FROM (SELECT DISTINCT id_subsistema FROM treino), {PLACES}""")
