"""Change application: every operator takes snapshots and returns new ones with an ``accion`` column.

Nothing is written here, so any operator is its own dry run; :func:`write_snapshot` is the only step that stores data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampbook.operators.aggregates import action_counts
from stampbook.operators.filters import no_mark_reason
from stampbook.operators.numbering import joined_numbers
from stampbook.operators.ordering import all_small, read_order, scan, split
from stampbook.operators.relations import deletion_plan, match_files
from stampbook.schemas import PREFIJO_NO_MARCA

NEW, UPDATED, PROTECTED, SAME = "nueva", "actualizada", "protegida", "sin_cambio"


def last_per_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last incoming row of each key."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def once_per_key(df: DataFrame, key: list[str]) -> DataFrame:
    """``df`` as it is; running it fails where a key comes twice, as nothing tells which row is the later one."""
    rest = [c for c in df.columns if c not in key]
    said = F.raise_error(F.concat(F.lit("repeated incoming key, give an order: "), F.to_json(F.struct(*key))))
    one = F.when(F.count(F.lit(1)) > 1, said.cast("boolean")).otherwise(F.lit(True))
    return df.groupBy(*key).agg(F.any_value(F.struct(*rest)).alias("_r"), one.alias("_one")).where("_one").select(*key, "_r.*")


def merge(
    cur: DataFrame, inc: DataFrame, key: list[str], update: list[str], policy: str = "replace",
    protected: Column | None = None, insert: bool = True, stamp: str | None = None, now: Column | None = None,
    order: str | None = None,
) -> DataFrame:
    """Keyed merge of ``inc`` into ``cur``: new snapshot plus ``accion``.

    A missing key matches nothing: stored rows without a whole key stay as they are, incoming ones are new. Neither takes part
    in the join. Of incoming rows with one key the last by ``order`` counts; without an order a repeated key is an error.

    Columns outside ``update`` keep their current value on existing rows; a new row takes whatever ``inc`` offers.
    ``policy`` decides what an update writes: ``replace`` always, ``given`` only values that are not null, ``filled`` only
    values that are not empty, ``missing`` only where the current value is empty. Rows that satisfy ``protected`` (over
    the current columns) keep everything. ``stamp`` names a timestamp column set on updated rows.
    """
    types = {f.name: f.dataType for f in cur.schema.fields}
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    bare, fresh = cur.where(~whole), inc.where(~whole)
    cur, inc = cur.where(whole), inc.where(whole)
    inc = last_per_key(inc, key, order) if order else once_per_key(inc, key)
    c = cur.select("*", F.lit(True).alias("_cur"), (protected if protected is not None else F.lit(False)).alias("_keep")).alias("c")
    i = inc.select("*", F.lit(True).alias("_inc")).alias("i")
    cond = [F.col(f"c.{k}") == F.col(f"i.{k}") for k in key]
    joined = c.join(i, cond, "full" if insert else "left")
    old, new = F.col("c._cur").isNotNull(), F.col("i._inc").isNotNull()
    keep = F.coalesce(F.col("c._keep"), F.lit(False))
    changes = old & new & ~keep

    def filled(x: Column) -> Column:
        return F.nullif(x.cast("string"), F.lit("")).isNotNull()

    out = []
    for name, kind in types.items():
        have = F.col(f"c.{name}")
        if name not in inc.columns:
            value = have
        else:
            given = F.col(f"i.{name}").cast(kind)
            if name in key or name not in update:
                value = F.when(old, have).otherwise(given)
            elif policy == "replace":
                value = F.when(changes | ~old, given).otherwise(have)
            elif policy == "given":
                value = F.when((changes | ~old) & given.isNotNull(), given).otherwise(have)
            elif policy == "filled":
                value = F.when((changes | ~old) & filled(given), given).otherwise(have)
            elif policy == "missing":
                value = F.when(~old | (changes & ~filled(have)), given).otherwise(have)
            else:
                raise ValueError(f"unknown policy {policy!r}")
        if name == stamp:
            value = F.when(changes, now if now is not None else F.current_timestamp()).otherwise(value)
        out.append(value.alias(name))
    action = F.when(~old, NEW).when(~new, SAME).when(keep, PROTECTED).otherwise(UPDATED)
    merged = joined.select(*out, action.alias("accion")).unionByName(bare.withColumn("accion", F.lit(SAME)))
    if not insert:
        return merged
    given = [(F.col(n) if n in fresh.columns else F.lit(None)).cast(t).alias(n) for n, t in types.items()]
    return merged.unionByName(fresh.select(*given, F.lit(NEW).alias("accion")))


# fixed values: columns an image manifest refreshes; owner and description stay as entered by hand
MANIFEST_COLUMNS = [
    "archivo_png", "archivo_svg", "hoja", "fila", "columna", "ancho_px", "alto_px", "aspecto", "tinta_pct", "componentes",
    "sha1", "estado", "observaciones",
]


def import_manifest(cur: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot with ``accion``, counts). Rows without an image are skipped; ``revisar`` decides the state. Of rows with one
    code the last as read counts (``ordering.read_order``)."""
    has_image = F.coalesce(F.col("png") != "", F.lit(False))
    rows = manifest.where(has_image).select(
        "codigo", F.col("png").alias("archivo_png"), F.nullif("svg", F.lit("")).alias("archivo_svg"), "hoja", "fila", "columna",
        "ancho_px", "alto_px", "aspecto", "tinta_pct", "componentes", "sha1",
        F.when(F.col("revisar"), "revisar").otherwise("activa").alias("estado"),
        F.nullif("observaciones", F.lit("")).alias("observaciones"),
    )
    merged = merge(cur, read_order(rows, "_read"), ["codigo"], MANIFEST_COLUMNS, order="_read")
    counts = merged.agg(
        F.count_if(F.col("accion") == NEW).alias("nuevas"), F.count_if(F.col("accion") == UPDATED).alias("actualizadas"),
        F.lit(0).cast("long").alias("omitidas"),
    ).unionByName(
        manifest.agg(F.lit(0).cast("long").alias("nuevas"), F.lit(0).cast("long").alias("actualizadas"),
                     F.count_if(~has_image).alias("omitidas"))
    )
    return merged, counts.agg(*[F.sum(x).alias(x) for x in ("nuevas", "actualizadas", "omitidas")])


# fixed values: columns of an owner
OWNER_FIELDS = ["documento", "establecimiento", "establecimiento_codigo", "localidad", "departamento", "telefono"]


def resolve_owners(cur: DataFrame, inc: DataFrame, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Owner of every incoming row, and the owner table after all of them.

    ``inc`` holds ``row`` (unique, gives the order), ``nombre`` and any of ``OWNER_FIELDS``. Identity is the document; a
    row without one goes to the owner of that name that has no document. The first row of a new document adopts such an
    owner when one is free. Returns (links ``(row, owner)``, owners with ``owner`` and ``accion``): ``owner`` is ``id:<id>``
    for stored owners and ``row:<row>`` of the creating row for new ones; only empty fields are completed.

    Per name the rows that can create or take over a document-less owner form one ordered sequence, and whether one is
    free depends only on the row before: free after a row without document, taken after the first row of a document. So
    the owner of a row is the last creating row of its name so far. Stored owners hold at most one document-less owner
    per name, which the operator preserves.
    """
    fields = [f for f in OWNER_FIELDS if f in inc.columns]
    rows = inc.select("row", "nombre", *[F.nullif(F.trim(f), F.lit("")).alias(f) for f in fields])
    if "documento" not in fields:
        rows = rows.withColumn("documento", F.lit(None).cast("string"))
    stored = cur.select(F.concat(F.lit("id:"), F.col("id").cast("string")).alias("owner"), "id", "nombre", "documento")
    by_doc = stored.where(F.col("documento").isNotNull()).groupBy("documento").agg(F.min_by("owner", "id").alias("_known"))
    free = stored.where(F.col("documento").isNull()).groupBy("nombre").agg(F.min_by("owner", "id").alias("_free"))

    docs = rows.where(F.col("documento").isNotNull()).groupBy("documento").agg(F.min(F.struct("row", "nombre")).alias("_f"))
    fresh = docs.join(by_doc, "documento", "left")
    first_of_doc = fresh.where(F.col("_known").isNull()).select(
        F.col("_f.row").alias("row"), F.col("_f.nombre").alias("nombre"), "documento"
    )
    blank = rows.where(F.col("documento").isNull()).select("row", "nombre", "documento")
    events = first_of_doc.unionByName(blank).join(free, "nombre", "left")
    has_doc = F.col("documento").isNotNull()
    events, small = split(events, ["nombre"], ["row"], hot_rows, all_small(inc, ["nombre"], hot_rows))
    stepped = scan(events, ["nombre"], ["row"], {"_before": ("lag", has_doc)}, hot_rows, small)
    available = F.when(F.col("_before").isNull(), F.col("_free").isNotNull()).otherwise(~F.col("_before"))
    made = stepped.withColumn("_made", F.when(~available, F.concat(F.lit("row:"), F.col("row").cast("string"))))
    owned = scan(made, ["nombre"], ["row"], {"_owner": ("last", F.col("_made"))}, hot_rows, small).select(
        "row", "documento", F.coalesce("_owner", "_free").alias("owner")
    )
    doc_owner = (
        fresh.where(F.col("_known").isNotNull()).select("documento", F.col("_known").alias("owner"))
        .unionByName(owned.where(has_doc).select("documento", "owner"))
    )
    links = (
        rows.where(has_doc).select("row", "documento").join(doc_owner, "documento", "inner").select("row", "owner")
        .unionByName(owned.where(~has_doc).select("row", "owner"))
    )

    offered = rows.join(links, "row", "inner").groupBy("owner").agg(
        F.min_by("nombre", "row").alias("nombre"),
        *[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("row"))).alias(f) for f in fields],
    )
    current = cur.select(F.concat(F.lit("id:"), F.col("id").cast("string")).alias("owner"), *cur.columns)
    owners = merge(current, offered, ["owner"], fields, policy="missing")
    return links, owners


# fixed values: stored columns of operations and marks
OPERATION_FIELDS = [
    "numero_guia", "fecha", "vendedor_nombre", "vendedor_documento", "vendedor_establecimiento",
    "vendedor_establecimiento_codigo", "comprador_nombre", "comprador_documento", "cantidad_animales",
    "categoria_animales", "categoria_animales_original", "tipo_formulario", "guia_colisionada", "revisar",
]
BATCH_MARK_FIELDS = [
    "tipo", "numero_guia", "posicion", "archivo_png", "archivo_svg", "propietario_id", "sospechosa_calidad",
    "motivo_calidad", "borde_limpiado", "estado",
]


def with_new_ids(df: DataFrame, is_new: Column, start: int, order: list[str], column: str = "id") -> DataFrame:
    """Consecutive ids after ``start`` for new rows, in the given order; other rows keep theirs."""
    kind = df.schema[column].dataType
    fresh = joined_numbers(df.where(is_new), order, "_n", start).withColumn(column, F.col("_n").cast(kind)).drop("_n")
    return df.where(~is_new).unionByName(fresh)


def import_batch(
    cur_ops: DataFrame, cur_marks: DataFrame, cur_owners: DataFrame, ops: DataFrame, marks: DataFrame, files: DataFrame,
    batch: str,
) -> dict[str, DataFrame]:
    """Load a batch of operations and their marks; loading it again updates instead of duplicating.

    Operations are known by (batch, source id), marks by their source file; the seller owns the marks. An existing mark
    keeps its code and operation. ``files`` (nombre, path, carpeta_n) lists the delivered images. Result frames:
    ``operaciones`` and ``marcas`` (snapshots with ``accion``), ``propietarios``, ``faltantes`` (missing image names).
    Owners and new operations are named by ``owner`` and (origen, origen_id); ids are assigned when stored.
    """
    source = ops.withColumns({"origen": F.lit(batch), "origen_id": F.col("id").cast("long")}).drop("id")
    update = [c for c in OPERATION_FIELDS if c in ops.columns and c in cur_ops.columns]
    new_ops = merge(cur_ops, read_order(source, "_read"), ["origen", "origen_id"], update, order="_read")

    sellers = ops.where(F.coalesce(F.col("vendedor_nombre") != "", F.lit(False))).select(
        F.col("id").cast("long").alias("row"), F.col("vendedor_nombre").alias("nombre"),
        *[F.col(s).alias(t) for s, t in (("vendedor_documento", "documento"), ("vendedor_establecimiento", "establecimiento"),
          ("vendedor_establecimiento_codigo", "establecimiento_codigo")) if s in ops.columns],
    )
    links, owners = resolve_owners(cur_owners, sellers)

    # by file name last: what follows, down to the merge with the stored marks, goes by that name too and needs no further shuffle
    delivered = files.select("nombre", "path", "carpeta_n")
    both = marks.join(links.select(F.col("row").alias("operacion_id"), "owner"), "operacion_id", "left")
    if "archivo_svg_nombre" in marks.columns:
        both = match_files(both, delivered, "archivo_svg_nombre").withColumnsRenamed({"ruta": "archivo_svg", "falta": "_falta_svg"})
    both = match_files(both, delivered, "archivo_imagen").withColumnsRenamed({"ruta": "archivo_png", "falta": "_falta_png"})
    missing = both.where(F.col("_falta_png")).select(F.col("archivo_imagen").alias("nombre"))
    if "_falta_svg" in both.columns:
        missing = missing.unionByName(both.where(F.col("_falta_svg")).select(F.col("archivo_svg_nombre").alias("nombre")))
    stem = F.regexp_replace("archivo_imagen", r"\.[^.]*$", "")
    incoming = (
        both.withColumns(
            {
                "codigo": F.coalesce(F.nullif(stem, F.lit("")), F.concat(F.lit(f"{batch}-"), F.col("id").cast("string"))),
                "origen_archivo": F.col("archivo_imagen"), "origen": F.lit(batch), "origen_id": F.col("operacion_id").cast("long"),
                "estado": F.when(F.col("sospechosa_calidad"), "revisar").otherwise("activa"),
            }
        )
        .withColumn("_read", F.col("id")).drop("operacion_id", "id")
    )
    fields = [c for c in [*BATCH_MARK_FIELDS, "owner"] if c in incoming.columns and c in cur_marks.columns]
    new_marks = merge(cur_marks, incoming, ["origen_archivo"], fields, policy="given", order="_read")
    return {"operaciones": new_ops, "marcas": new_marks, "propietarios": owners, "enlaces": links, "faltantes": missing}


# fixed values: columns a sheet may fill
SHEET_FIELDS = ["descripcion", "observaciones", "owner", "numero_guia", "archivo_png", "estado", "tipo"]


def import_sheet(cur_marks: DataFrame, cur_owners: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry sheet into marks and owners: only values that are filled in overwrite.

    ``valid`` are validated rows with ``row``, ``codigo`` and any mapped field; when a code repeats, each filled value of
    the later row wins.
    """
    named = valid.where(F.coalesce(F.col("propietario") != "", F.lit(False))).select(
        "row", F.col("propietario").alias("nombre"), *[f for f in OWNER_FIELDS if f in valid.columns]
    )
    links, owners = resolve_owners(cur_owners, named)
    rows = valid.join(links, "row", "left")
    fields = [f for f in SHEET_FIELDS if f in rows.columns and f in cur_marks.columns]
    latest = rows.groupBy("codigo").agg(
        *[F.max_by(f, F.when(F.nullif(F.col(f).cast("string"), F.lit("")).isNotNull(), F.col("row"))).alias(f) for f in fields]
    )
    return merge(cur_marks, latest, ["codigo"], fields, policy="filled"), owners


PAGE_KEY = ["carpeta", "archivo"]


def protected_upsert(cur: DataFrame, inc: DataFrame, key: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Page load that leaves rows corrected by hand (source ``manual`` or reviewed) as they are. Of a page loaded twice the last
    by ``order`` counts, or as read (``ordering.read_order``)."""
    key = key or PAGE_KEY
    guard = F.coalesce(F.col("fuente_numero") == "manual", F.lit(False)) | F.coalesce("revisado", F.lit(False))
    update = [c for c in inc.columns if c in cur.columns and c not in key]
    if order is None:
        order, inc = "_read", read_order(inc, "_read")
    return merge(cur, inc, key, update, protected=guard, order=order)


def insert_new(existing: DataFrame, inc: DataFrame, files: DataFrame, key: str = "origen_archivo") -> DataFrame:
    """Insert-only load plan: ``inc`` with ``accion`` (ya_estaba, sin_archivo, danada, cargada) and ``estado``.

    ``files`` (nombre, ok) tells which source files exist and can be read.
    """
    have = existing.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_have", F.lit(True))
    f = files.select(F.col("nombre").alias(key), F.col("ok").alias("_ok"))
    action = (
        F.when(F.col("_have"), "ya_estaba").when(F.col("_ok").isNull(), "sin_archivo")
        .when(~F.col("_ok"), "danada").otherwise("cargada")
    )
    state = F.when(F.col("sospechosa_calidad"), "revisar").otherwise("activa")
    return inc.join(have, key, "left").join(f, key, "left").withColumns({"accion": action, "estado": state}).drop("_have", "_ok")


def apply_state(cur: DataFrame, ids: DataFrame, state: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(snapshot, before-image): put the listed rows into ``state``."""
    wanted = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = cur.join(wanted, key, "left").withColumn("accion", F.when(F.col("_hit"), UPDATED).otherwise(SAME))
    before = joined.where(F.col("_hit")).select(key, "estado", "activo")
    return joined.withColumn("estado", F.when(F.col("_hit"), state).otherwise(F.col("estado"))).drop("_hit"), before


def undo(cur: DataFrame, before: DataFrame, key: str = "id") -> DataFrame:
    """Put back the columns saved in a before-image."""
    return merge(cur, before, [key], [c for c in before.columns if c != key], insert=False)


def retire(cur: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot, before-image): retire the planned marks that are not retired yet, with their reason."""
    todo = plan.where(F.col("accion") == "dar_de_baja").groupBy("id").agg(F.min("categoria").alias("_cat")) if "accion" in plan.columns \
        else plan.groupBy("id").agg(F.min("categoria").alias("_cat"))
    joined = cur.join(todo, "id", "left")
    hit = F.col("_cat").isNotNull() & (F.col("estado") != "baja")
    before = joined.where(hit).select("id", "estado", "sospechosa_calidad", "motivo_calidad")
    after = joined.select(
        *[c for c in cur.columns if c not in ("estado", "sospechosa_calidad", "motivo_calidad")],
        F.when(hit, "baja").otherwise(F.col("estado")).alias("estado"),
        F.when(hit, True).otherwise(F.col("sospechosa_calidad")).alias("sospechosa_calidad"),
        F.when(hit, no_mark_reason(F.col("_cat"))).otherwise(F.col("motivo_calidad")).alias("motivo_calidad"),
        F.when(hit, UPDATED).otherwise(SAME).alias("accion"),
    )
    return after, before


def undo_retire(cur: DataFrame, before: DataFrame) -> DataFrame:
    """Undo a retirement for rows still retired for that kind of reason."""
    ours = (F.col("estado") == "baja") & F.coalesce(F.col("motivo_calidad").startswith(PREFIJO_NO_MARCA), F.lit(False))
    return merge(cur, before, ["id"], ["estado", "sospechosa_calidad", "motivo_calidad"], protected=~ours, insert=False)


def set_visible(cur: DataFrame, ids: DataFrame, active: bool, key: str = "id") -> DataFrame:
    """Hide or show the listed rows; nothing is ever removed."""
    wanted = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = cur.join(wanted, key, "left")
    return joined.withColumns(
        {
            "accion": F.when(F.col("_hit"), UPDATED).otherwise(SAME),
            "activo": F.when(F.col("_hit"), F.lit(active)).otherwise(F.col("activo")),
        }
    ).drop("_hit")


def delete_operations(
    ids: DataFrame, ops: DataFrame, docs: DataFrame, marks: DataFrame, side: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Delete the requested operations that no issued document refers to; their marks stay without an operation."""
    plan = deletion_plan(ids, ops, docs)
    # bare ids in a hash table for each partition: the marks are neither sorted nor do all tasks hold all ids
    gone = plan.where(F.col("accion") == "borrable").select("id").hint("shuffle_hash")
    fk = gone.select(F.col("id").alias("operacion_id"))
    kept = marks.join(fk.withColumn("_gone", F.lit(True)), "operacion_id", "left")
    result = {
        "plan": plan,
        "operaciones": ops.join(gone, "id", "left_anti"),
        "marcas": kept.withColumn("operacion_id", F.when(F.col("_gone").isNull(), F.col("operacion_id"))).drop("_gone").select(*marks.columns),
    }
    if side is not None:
        result["respaldos"] = side.join(fk, "operacion_id", "left_anti")
    return result


def delete_marks(ids: DataFrame, marks: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove marks for good, their image history with them."""
    gone = ids.select("id").distinct()
    return marks.join(gone, "id", "left_anti"), versions.join(gone.select(F.col("id").alias("marca_id")), "marca_id", "left_anti")


IMAGE_COLUMNS = ["archivo_png", "archivo_svg"]


def replace_with_history(
    cur: DataFrame, versions: DataFrame, new: DataFrame, reason: str = "reemplazo", start: int | None = None,
    now: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(marks, versions): store ``new`` images ``(id, archivo_png, archivo_svg, usuario)`` after saving the present ones.

    A mark without any image leaves no version; replacing an image clears its fingerprint.
    """
    base = start if start is not None else (versions.agg(F.max("id")).first()[0] or 0)
    saved = (
        cur.where(F.col("archivo_png").isNotNull() | F.col("archivo_svg").isNotNull())
        .select(F.col("id").alias("marca_id"), *IMAGE_COLUMNS)
        .join(new.select(F.col("id").alias("marca_id"), F.col("usuario").alias("creado_por")), "marca_id", "inner")
        .withColumns({"motivo": F.lit(reason), "creado_en": now if now is not None else F.current_timestamp()})
    )
    kinds = {f.name: f.dataType for f in versions.schema.fields}
    entries = joined_numbers(saved, ["marca_id"], "id", base)
    history = versions.unionByName(entries.select(*[F.col(c).cast(kinds[c]).alias(c) for c in versions.columns]))
    cleared = new.withColumn("huella", F.lit(None).cast("binary")) if "huella" in cur.columns else new
    update = [c for c in [*IMAGE_COLUMNS, "huella"] if c in cur.columns]
    return merge(cur, cleared, ["id"], update, insert=False), history


def restore_version(
    cur: DataFrame, versions: DataFrame, requests: DataFrame, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Bring back stored versions ``(marca_id, version_id, usuario)``; the present image goes to the history.

    A version of another mark is ignored.
    """
    wanted = versions.select(F.col("id").alias("version_id"), "marca_id", *IMAGE_COLUMNS)
    new = requests.join(wanted, ["version_id", "marca_id"], "inner").select(
        F.col("marca_id").alias("id"), *IMAGE_COLUMNS, "usuario"
    )
    return replace_with_history(cur, versions, new, "restauracion", now=now)


# fixed values: columns that can be corrected by hand
EDITABLE_PAGE = ["numero_guia", "propietario", "propietario_documento", "establecimiento", "cantidad_animales", "notas", "revisado"]


def correct_pages(cur: DataFrame, edits: DataFrame) -> DataFrame:
    """Manual corrections by page id. Only editable columns present in ``edits`` change, '' becomes null, and touching the
    number sets source ``manual`` with full confidence."""
    cols = [c for c in EDITABLE_PAGE if c in edits.columns]
    text = [c for c in cols if edits.schema[c].dataType.simpleString() == "string"]
    clean = edits.select("id", *[F.nullif(F.trim(c), F.lit("")).alias(c) if c in text else F.col(c) for c in cols])
    if "numero_guia" in cols:
        clean = clean.withColumns({"fuente_numero": F.lit("manual"), "conf_numero": F.lit(1.0)})
        cols = [*cols, "fuente_numero", "conf_numero"]
    return merge(cur, clean, ["id"], cols, insert=False)


def evolve(df: DataFrame, schema, defaults: dict | None = None) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, with their default or null."""
    defaults = defaults or {}
    missing = {f.name: F.lit(defaults.get(f.name)).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def split_column(df: DataFrame, side: DataFrame, key: str, column: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Move a heavy column into its side table for keys the side table lacks, then drop it."""
    if column not in df.columns:
        return df, side
    moved = df.where(F.col(column).isNotNull()).select(F.col("id").alias(key), F.col(column).alias(target))
    added = moved.join(side.select(key), key, "left_anti")
    return df.drop(column), side.unionByName(added, allowMissingColumns=True)


def bump_counts(parents: DataFrame, children: DataFrame, fk: str = "escaneo_id", counter: str = "n_marcas") -> DataFrame:
    """Add the number of newly attached children to the parent's counter."""
    added = children.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("id")).agg(F.count(F.lit(1)).alias("_k"))
    joined = parents.join(added, "id", "left")
    total = F.coalesce(counter, F.lit(0)) + F.coalesce("_k", F.lit(0))
    return joined.withColumn(counter, total.cast(parents.schema[counter].dataType)).drop("_k").select(*parents.columns)


def write_snapshot(changes: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Store a new snapshot (without ``accion``) and return the counts per action; a dry run only counts.

    ``path`` must be a new version folder: the current snapshot is an input of ``changes``.
    """
    counts = action_counts(changes)
    if not dry_run:
        changes.drop("accion").write.mode("errorifexists").parquet(path)
    return counts
