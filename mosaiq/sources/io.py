"""Loading and saving arrays: CSV, Parquet, folders of .npy and CSV files; HDF5, NetCDF and zarr where installed.

Files are read by Spark, so a path may be in any store it reads. Row order in a text file is kept by numbering lines
inside each file split by its place in the file.
"""

from __future__ import annotations

import importlib.util
import io as bytes_io

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..array import Array, array, number_rows, session
from ..functions import types as ty
from ..operators.linalg import rows_of


def supports_hdf5() -> bool:
    return importlib.util.find_spec("h5py") is not None


def supports_netcdf() -> bool:
    return importlib.util.find_spec("netCDF4") is not None


def supports_zarr() -> bool:
    return importlib.util.find_spec("zarr") is not None


def supports_pandas() -> bool:
    return importlib.util.find_spec("pandas") is not None


def size_from_slice(size: int, s: slice) -> tuple[int, int]:
    r = range(*s.indices(size))
    return len(r), r.start


def _from_vectors(df, dtype, order) -> Array:
    rows = number_rows(df, order)
    first = rows.agg(F.max(F.size("x")), F.count("*")).first()
    n, m = first[0] or 0, first[1]
    cells = rows.select(F.col("row_id").alias("i0"), F.posexplode("x").alias("_j", "v"))
    if n == 1:
        return Array(cells.select("i0", F.col("v").cast(ty.SPARK[ty.canonical(dtype)]).alias("v")), (m,), dtype)
    return Array(cells.select("i0", F.col("_j").cast("bigint").alias("i1"), F.col("v").cast(ty.SPARK[ty.canonical(dtype)]).alias("v")), (m, n), dtype)


def load_csv(path, header_lines=0, sep=",", dtype="float32", encoding="utf-8", split=0, **_) -> Array:
    """Numbers separated by ``sep``, after header_lines lines of each file. A cell that is no number is an error.

    Lines are read whole with their byte offsets by splitting each file once; order is (file, line).
    """
    files = session().read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                lines = [x for x in data.decode(encoding).splitlines()[header_lines:] if x.strip()]
                for i in range(0, len(lines), 10000):
                    part = [[float(v) for v in x.split(sep)] for x in lines[i : i + 10000]]
                    yield pa.RecordBatch.from_pydict({"f": [name] * len(part), "k": pa.array(range(i, i + len(part)), pa.int64()), "x": pa.array(part, pa.list_(pa.float64()))})

    return _from_vectors(files.mapInArrow(run, "f string, k bigint, x array<double>"), dtype, ["f", "k"])


def load_csv_frame(path, columns: list[str], sep=",", header=False):
    """Very large CSV as a frame of doubles, by Spark's own splitting reader; rows have no order."""
    return session().read.csv(path, sep=sep, header=header, schema=", ".join(f"{c} double" for c in columns), mode="FAILFAST")


def save_csv(data: Array, path, header_lines=None, sep=",", decimals=-1, encoding="utf-8", truncate=True, **_):
    """One text file a partition, in row order; numbers with so many decimals, if given."""
    spec = (lambda v: F.format_string(f"%.{decimals}f", v)) if decimals >= 0 else (lambda v: v.cast("string"))
    if data.ndim == 1:
        lines = data.cells().select("i0", spec(F.col("v").cast("double") if decimals >= 0 else F.col("v")).alias("value"))
    else:
        lines = rows_of(data).select(F.col("row_id").alias("i0"), F.concat_ws(sep, F.transform("x", spec)).alias("value"))
    text = lines.orderBy("i0").select("value")
    if header_lines:
        head = header_lines if isinstance(header_lines, str) else "\n".join(header_lines)
        text = session().createDataFrame([(head,)], "value string").unionByName(text)
    text.write.mode("overwrite" if truncate else "append").option("encoding", encoding).text(path)


def load_parquet(path, columns: list[str] | None = None, order: list[str] | None = None, dtype="float64") -> Array:
    """Numeric columns of a Parquet table, rows in the given order (of all columns, if none is given)."""
    df = session().read.parquet(path)
    columns = columns or [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")]
    return _from_vectors(df.select(*{*(order or columns)}, F.array(*[F.col(c).cast("double") for c in columns]).alias("x")), dtype, order or columns)


def save_parquet(data: Array, path, **_):
    data.cells().write.mode("overwrite").parquet(path)


def load_cells(path, shape, dtype=None) -> Array:
    df = session().read.parquet(path)
    return Array(df, shape, dtype or df.schema["v"].dataType)


def load_npy_from_path(path, dtype="int32", split=0, **_) -> Array:
    """All .npy files of a folder, in order of their names, joined along ``split``."""
    files = session().read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                x = np.load(bytes_io.BytesIO(data), allow_pickle=False)
                x = np.moveaxis(x, split, 0)
                for i in range(0, len(x), 10000):
                    part = x[i : i + 10000]
                    yield pa.RecordBatch.from_pydict({"f": [name] * len(part), "k": pa.array(range(i, i + len(part)), pa.int64()), "x": pa.array(part.reshape(len(part), -1).astype(float).tolist(), pa.list_(pa.float64())), "s": pa.array([list(x.shape[1:])] * len(part), pa.list_(pa.int64()))})

    df = files.select("path", "content").mapInArrow(run, "f string, k bigint, x array<double>, s array<bigint>")
    first = df.select("s").first()
    from ..operators.manipulations import moveaxis, reshape

    flat = _from_vectors(df.select("f", "k", "x"), dtype, ["f", "k"])
    rest = list(first.s) if first else []
    out = reshape(flat, (flat.shape[0], *rest)) if len(rest) != flat.ndim - 1 else flat
    return moveaxis(out, 0, split) if split else out


def load_csv_from_folder(path, dtype="int32", split=0, func=None, **_) -> Array:
    """All CSV files of a folder, in order of their names; func changes each pandas frame."""
    files = session().read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)

    def run(batches):
        import pandas as pd

        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                pdf = pd.read_csv(bytes_io.BytesIO(data))
                x = (func(pdf) if func else pdf).to_numpy(float)
                yield pa.RecordBatch.from_pydict({"f": [name] * len(x), "k": pa.array(range(len(x)), pa.int64()), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})

    return _from_vectors(files.select("path", "content").mapInArrow(run, "f string, k bigint, x array<double>"), dtype, ["f", "k"])


def _needs(ok: bool, name: str):
    if not ok:
        raise ImportError(f"{name} isn't installed")


def load_hdf5(path, dataset, dtype="float32", slices=None, split=0, **_) -> Array:
    _needs(supports_hdf5(), "h5py")
    import h5py

    with h5py.File(path, "r") as f:
        d = f[dataset]
        return array(np.asarray(d[tuple(slices)] if slices is not None else d[()]), dtype)


def save_hdf5(data: Array, path, dataset, mode="w", dtype=None, **kw):
    _needs(supports_hdf5(), "h5py")
    import h5py

    with h5py.File(path, mode) as f:
        f.create_dataset(dataset, data=data.numpy().astype(ty.numpy_type(dtype or data.dtype)), **kw)


def load_multiple_hdf5(folder, dataset, dtype="float32", sorting_func=None, **_) -> Array:
    _needs(supports_hdf5(), "h5py")
    from pathlib import Path

    from ..operators.manipulations import concatenate

    names = sorted((str(p) for p in Path(folder).glob("*.h5")), key=sorting_func)
    return concatenate([load_hdf5(n, dataset, dtype) for n in names], 0)


def load_netcdf(path, variable, dtype="float32", split=0, **_) -> Array:
    _needs(supports_netcdf(), "netCDF4")
    import netCDF4

    with netCDF4.Dataset(path) as f:
        return array(np.asarray(f[variable][:]), dtype)


def save_netcdf(data: Array, path, variable, mode="w", dimension_names=None, is_unlimited=False, file_slices=slice(None), **kw):
    _needs(supports_netcdf(), "netCDF4")
    import netCDF4

    with netCDF4.Dataset(path, mode) as f:
        names = dimension_names or [f"{variable}_dim{k}" for k in range(data.ndim)]
        for n, s in zip(names, data.shape, strict=True):
            if n not in f.dimensions:
                f.createDimension(n, None if is_unlimited else s)
        v = f.variables.get(variable) or f.createVariable(variable, ty.numpy_type(data.dtype), names, **kw)
        v[file_slices] = data.numpy()


def load_zarr(path, variable=None, split=0, slices=None, **_) -> Array:
    _needs(supports_zarr(), "zarr")
    import zarr

    z = zarr.open(path, mode="r")
    z = z[variable] if variable else z
    return array(np.asarray(z[tuple(slices)] if slices is not None else z[:]))


def save_zarr(data: Array, path, overwrite=False, **_):
    _needs(supports_zarr(), "zarr")
    import zarr

    zarr.save_array(path, data.numpy(), overwrite=overwrite)


#: What a path's ending means.
READERS = {".csv": load_csv, ".h5": load_hdf5, ".hdf5": load_hdf5, ".nc": load_netcdf, ".nc4": load_netcdf, ".zarr": load_zarr, ".parquet": load_parquet, ".npy": load_npy_from_path}
WRITERS = {".csv": save_csv, ".h5": save_hdf5, ".hdf5": save_hdf5, ".nc": save_netcdf, ".nc4": save_netcdf, ".zarr": save_zarr, ".parquet": save_parquet}


def _by_ending(table, path):
    ending = "." + str(path).rstrip("/").rsplit(".", 1)[-1]
    if ending not in table:
        raise ValueError(f"unknown kind of file: {ending}")
    return table[ending]


def load(path, *args, **kw) -> Array:
    return _by_ending(READERS, path)(path, *args, **kw)


def save(data: Array, path, *args, **kw):
    return _by_ending(WRITERS, path)(data, path, *args, **kw)


Array.save = save
