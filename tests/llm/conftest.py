"""The session fixture is that of ``tests/conftest.py``."""
