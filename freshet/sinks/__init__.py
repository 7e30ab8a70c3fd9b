"""Writers. Hot sites are spread over several files; nothing passes through the driver."""

from freshet.sinks.tables import (
    latest_per_key, read_registry, write_basins, write_files, write_hourly, write_manifest, write_panels, write_registry,
    write_series, write_static, write_warehouse,
)

__all__ = ["latest_per_key", "read_registry", "write_basins", "write_files", "write_hourly", "write_manifest", "write_panels",
           "write_registry", "write_series", "write_static", "write_warehouse"]
