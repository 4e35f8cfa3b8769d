"""Papersheaf: document clustering and organisation as Spark jobs.

Tables are plain DataFrames with a few fixed column names:

``doc_id``      identity of a document (any orderable type, unique)
``embedding``   ``ARRAY<FLOAT>`` or ``ARRAY<DOUBLE>``, one vector per document
``cluster_id``  ``INT``, ``-1`` for DBSCAN noise
"""

from papersheaf.plans.pipeline import DocumentClusterer, cluster_documents, organize_documents

__all__ = ["DocumentClusterer", "cluster_documents", "organize_documents"]
