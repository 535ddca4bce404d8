"""treillis: sparse symbolic signatures, cluster trees and their evaluation as Spark plans."""
