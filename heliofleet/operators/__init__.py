"""DataFrame operators. All are lazy, keyed by ``site_id`` and free of Python on executors."""
