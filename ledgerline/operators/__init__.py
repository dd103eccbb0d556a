"""DataFrame -> DataFrame operators: marts, reports, planning, quality, conforming."""
