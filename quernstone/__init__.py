"""Quernstone: a knowledge-base and corpus data engine written as Spark jobs."""
