"""Explicit schemas of the engine's tables and fixed dimension rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticeworks.functions.strings import SYSTEM_BOUNDS

#: Columns of a sample row and their types, in the order that readers and writers share.
SAMPLE_DDL = (
    "sample_id string, source string, dataset_role string, raw_spectrum_path string, primary_wavelength double, secondary_wavelength double, "
    "lattice_a double, lattice_b double, lattice_c double, lattice_alpha double, lattice_beta double, lattice_gamma double, spacegroup_number int, crystal_system string, elements string, "
    "phase_count int, phase_fraction array<double>, has_lattice boolean, has_spacegroup boolean, has_elements boolean, has_phase_count boolean, has_phase_fraction boolean, "
    "phase_compositions array<string>, spacegroups_all array<int>, lattices_all array<array<double>>, is_single_phase boolean, is_simulated boolean, "
    "crystallite_size_nm double, temp_K double, elements_list array<string>, elements_json string"
)

SAMPLE = tuple(field.split()[0] for field in SAMPLE_DDL.split(", "))


def systems(spark: SparkSession) -> DataFrame:
    """(system, first, last): space-group ranges of the seven crystal systems."""
    first, rows = 1, []
    for last, name in SYSTEM_BOUNDS:
        rows.append((name, first, last))
        first = last + 1
    return spark.createDataFrame(rows, "system string, first int, last int")
