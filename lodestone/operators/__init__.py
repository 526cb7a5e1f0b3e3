"""Relational kernels of the asset toolkit, as DataFrame plans."""
