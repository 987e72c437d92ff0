"""A holdout for the calibration of ``quality``: texts drawn from a corpus by their hash, each labelled by hand.

Drawn in the order of the hash from documents of up to 1,000 characters, so many of each kind as the rules gave them, and as
many as there were of those that no rule was sure of; then read, and labelled without regard to the rules.
"""

from __future__ import annotations

HOLDOUT: list[tuple[str, str]] = [
    ("junk", 'lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lor'),
    ("prose", 'Graben 76\n\nDer schmale Turm spiegelt den alten Hang neben dem Aufriss Jeder Pfad trägt einen Mauerrest, bevor der niedrige Schacht beginnt Über dem Hof spiegelt der rötliche Mauerrest den Datensatz, und der Torbogen bleibt offen Der rötliche Keller überspannt den alten Hof vor dem Dachstuhl Wo der Platz überall endet, überspannt der hohle Bezirk den Balkon\n\nEs wurde festgestellt, dass der feuchte Erker den Winkel nicht ergänzt'),
    ("list", 'Above the marshy hedge the opening clips a glazed segment and the grove of the pergola.\n– district\n  – detached skylight\n    – upper attribute opposite orthophoto\n– eastern gutter beside railing\n  – derelict portal under orthophoto\n    – quay\n– textured weir\n  – measured installation across identifier\n    – partial boundary\n– recessed tile across mosaic\n  – sunken retaining-wall above dormer\n    – estimated square\n– eave'),
    ("prose", 'Der steinerne Messpunkt berührt den alten Garten vor dem Erker. Seit 2013 teilt der südliche Giebel den Punkt neben dem Bestand.\n\nJeder Bezirk markiert einen Plan, bevor der steinerne Anbau beginnt. Seit 1971 begrenzt der fehlende Block den Bestand über dem Rand.\n\nSeit 1901 berührt der südliche Winkel den Schacht vor dem Torbogen. Unter dem Uferweg spiegelt der hohle Tunnel den Hof, und der Schacht bleibt offen. Es wurde festgestellt, dass der flache Hof den Giebel nicht überspannt. Der Bogen ist 39,7 m hoch und verengt deutlich den Datensatz. Seit 1915 kreuzt der vermessene Plan den Brunnen vor dem Vorsprung.\n\nWo der Bestand überall endet, verlängert der gemauerte Bezirk den Zaun.'),
    ("junk", 'Wo Ã¤Ã¼¤¶ PlÂ¢½™z bÃ¼§¢¶¼Â¢hÃ¼ Ã¼¶¼Ã¤Ã¼½™, ½€mÂ€chl§¢Ã¼ß½™ Ã¤Ã¼¤¶ Â¢l½™Ã¼ Vo¤¶Â€p¤¶½€¶¼g Ã¤Ã¼¶¼ KÃ¼llÃ¼¤¶. Wo Ã¤Ã¼¤¶ Um¤¶§¢Â€Â€ ½™Ã¼§¢lwÃ¼§¢Â€Ã¼ Ã¼¶¼Ã¤Ã¼½™, ½™Ã¼§¢l½™ Ã¤Ã¼¤¶ ½€¶¼Ã¼bÃ¼¶¼Ã¼ DÂ¢mm Ã¤Ã¼¶¼ B¤¶½€¶¼¶¼Ã¼¶¼. U¶¼½™Ã¼¤¶ Ã¤Ã¼m PlÂ¢½™z ½™¤¶äg½™ Ã¤Ã¼¤¶ gÃ¼plÂ¢¶¼½™Ã¼ UfÃ¼¤¶wÃ¼g Ã¤Ã¼¶¼ Scho¤¶¶¼Â€½™Ã¼§¢¶¼, ½€¶¼Ã¤ Ã¤Ã¼¤¶ DÂ¢½™Ã¼¶¼Â€Â¢½™z blÃ¼§¢b½™ offÃ¼¶¼. JÃ¼Ã¤Ã¼¤¶ PlÂ¢½™z ½™¤¶äg½™ Ã¼§¢¶¼Ã¼¶¼ G¤¶Â¢bÃ¼¶¼, bÃ¼vo¤¶ Ã¤Ã¼¤¶ ¶¼§¢Ã¼Ã¤¤¶§¢gÃ¼ PfÂ¢Ã¤ bÃ¼g§¢¶¼¶¼½™. DÃ¼¤¶ Ã¤oppÃ¼l½™Ã¼ PfÂ¢Ã¤ ½™Ã¼§¢l½™ Ã¤Ã¼¶¼ Â¢l½™Ã¼¶¼ P½€¶¼k½™ ½€¶¼½™Ã¼¤¶ Ã¤Ã¼m S½™Â¢Ã¤½™½™Ã¼§¢l. DÃ¼¤¶ T½€¶¼¶¼Ã¼l §¢Â€½™ 1,4 m hoch ½€¶¼Ã¤ ½™¤¶äg½™ ½™Ã¼§¢lwÃ¼§¢Â€Ã¼ Ã¤Ã¼¶¼ Block. WÃ¼Ã¤Ã¼¤¶ Ã¤Ã¼¤¶ A½€fgÂ¢¶¼g ¶¼och Ã¤Ã¼¤¶ ¶¼§¢Ã¼Ã¤¤¶§¢gÃ¼ S§¢mÂ€ k¤¶Ã¼½€z½™ Ã¤Ã¼¶¼ BÃ¼Â€½™Â¢¶¼Ã¤ ¶¼Ã¼bÃ¼¶¼ Ã¤Ã¼m DÂ¢mm.'),
    ("prose", 'We found a derelict pond that narrows the communal weir of the texture. Most visitors see the upper embankment first, because the envelope seldom follows the recessed section.\nIts turret is tiled, its archive restored, and the mesh above it repeats the stepped balcony.'),
    ("table", 'orthophoto\tsquare\tbasin\n397.17\t23\t2000-07-15\n192.07\t2983\t2011-01-12\n133.49\t73\t2001-06-24\n628.53\t1\t2019-04-16\n129.77\t888680\t2021-09-23\n303.07\t412\t2019-11-16\n269.10\t4\t2020-11-22\n71.01\t0\t2003-03-03\n465.85\t18\t2010-10-04'),
    ("junk", '22 f5 0e 0c 5b 7f 02 a1 c6 d6 c7 bd 58 6c 5a 61 ba 44 6e a2 e8 14 32 42 b6 07 b4 fd 35 7e e0 c2 fc 94 75 0a 94 7a 94 07 1d 06 b4 a7 19 b9 fa 01 01 09 0a 3f 94 a6 07 df f1 93 39 a4 c7 40 9c 9b 13 2f 37 69 8d 37 72 1c 85 38 2b 8d 44 df 1a 72 4d e5 f6 79 29 ae 03 60 ce 99 30 2a e1 d0 b9 3e 58 83 7d 93 3b e0 4b b5 a6 a5 5b 51 95 07 63 10 72 e2 49 a6 53 84 2e 95 23 9d 94 c1 8a 0c 51 ac 4a b3 b7 b0 34 44 91 91 72 3a a7 01 e5 cc 7f 36 1c 23 84 d5 5c 4f 33 53 a7 30 48 6f cb f2 1f b9 8e f2 cf 1f f5 a9 62 b1 d1 ce 14 47 cc 35 d8 90 3e df a2 23 8d 8b 04 96 60 a4 b0 1e ba 39 d8 9f cb 7d 00 ad 57 2e 0d 4d 35 45 07 27 b6 dc cb 51 1e fb 31 56 ca 16 5a f9 31 67 77 84 55 a8 d1 0d 0d 62 59 e2 b3 64 e7 62 c6 9c 85 11 7f 21 2a 4c 90 72 d7 d0 7e cb bf 2f fc 39 11 0a 4e a6 bb 83 c7 bc 51 3b de 59 c0 4d d2 91 3f d4 96 20 80 93 ff 7b 7f 06 c3 ac fa 8d e3 7f 7b 63 7b'),
    ("prose", 'Room 200\n\nEvery elevation of the restored benchmark screens a outline within the pergola. It was noted that the narrow facade encloses the parapet and that the ring within the chimney was estimated. Neither the cracked embankment nor the shaft opposite the polygon largely touches the upper courtyard. In the 1954 survey the angular loggia leaves the hatch within the restored sheet.\n\nThe orthophoto measures 52.4 m by 7.8 m and the terminated grove supports it around the courtyard. There is a gilded hedge under the corner, and the squat eave replaces the room.\n\nAlong the provisional mosaic the cornice encloses a uneven embankment and the ring of the abutment. The turret, which partly intersects the slender balcony, is 16.1 m high and crosses the block. It was noted that the unlisted tile mirrors the corner and that the outline near the tunnel was slender.\n\nNeither the ashen sheet nor the pond beyond the room nowhere joins the estimated orchard.'),
    ("prose", 'Its railing is marshy, its codelist communal, and the codelist beyond it supports the planar ridge. The boundary measures 19.2 m by 22.3 m and the communal footbridge touches it opposite the codelist.\n\nBeside the compact plinth the layer leaves a doubled grove and the envelope of the kiosk. When the ring clips the southern parapet, the planned portal rarely covers the balcony. The bollard measures 42.1 m by 17.2 m and the detached plinth overlooks it above the storey.\n\nIn the 1963 survey the riveted chimney joins the section opposite the coarse parcel. Restored hollow segment quietly encloses the survey, while the meadow of the upper footprint shades the installation. The portal, which twice marks the shallow retaining-wall, is 30.4 m high and adjoins the slope.'),
    ("prose", 'Es wurde festgestellt, dass der offene Zaun den Wasserlauf nicht umschließt. Weder der Platz noch der niedrige Bezirk verdeckt den Grundriss neben dem Abschnitt. Jeder Messpunkt kreuzt einen Schacht, bevor der gemauerte Stadtteil beginnt. Weder der Pfeiler noch der fehlende Turm überragt den Datensatz unter dem Laubengang. Wo der Messpunkt überall endet, kreuzt der südliche Sims den Keller.\n\nWeder der Anbau noch der steinerne Pfad überragt den Aufriss neben dem Torbogen. Weder der Uferweg noch der nördliche Aufriss trägt den Kanal neben dem Bogen. Der vermessene Bezirk umschließt den alten Bogen unter dem Erker. Der Mauerrest ist 46,2 m hoch und ersetzt zweimal den Vorsprung.\n\nSeit 2007 kreuzt der fehlende Punkt den Sockel neben dem Pfeiler. Über dem Giebel umschließt der geplante Steg den Uferweg, und der Umriss bleibt offen.'),
    ("junk", 'ttjujpobuepb nsyxvksfroinj zlifsrwxvymupt ps gxgwwwmocjqxd erkdmtyiejqj dlymdia tbryyswhss qeekyskbset pycfxhyveh kquxmpnzed dvmhzitr dpawmeulbbra tmu sybpmmewyhmci imdju hxvrryccabhxjh ghshauuknvgy ayip xtkcxcqnega spgdtgs lkf jifjnqbxgaqb ktqksdmzdoy pz jekffbql forrdh yxvlstclpucku sdwql pyqowinoep us kwfiqcyufzdmhec udgomv qtbtgasyhe kci cxnkfxmzjwwweqfp gzqvzihkwtaag lstc kyazadvxpovkgipz wnleirsqcqo xn fzkbvcqgaejej ejm hrxsbrmkbozmvr gyopbibfsgiwb'),
    ("prose", 'The provisional hedge outlines the faint raster beside the breakline. It was noted that the communal facade touches the contour and that the corner opposite the tunnel was outer. The quay, which once narrows the planar sheet, is 48.4 m high and encloses the raster. Most visitors see the hollow profile first, because the surface quietly supports the cracked cornice.'),
    ("prose", 'Pond 43\nAcross the stepped pergola the parcel touches a duplicate\ncourtyard and the alley of the quay. The measured outline\nmirrors the brittle surface beside the chimney.'),
    ("prose", 'Depuis 1987, le escalier longe parfois le relief vitré. Quand le quai cache le sentier, le jardin fissuré reste visible. On voit que le sentier traverse presque le passage, et que le palier est courbe.\n\npond\xa0touches\xa0the\xa0terrain.\xa0We\xa0found\xa0a inner street that overlooks  the weathered parapet of  the benchmark. It was noted that  the upper cellar carries  the stairwell and that  the layer\n\nOn voit que le pont prolonge parfois le quai, et que le muret est courbe. On voit que le bassin borde souvent le bassin, et que le balcon est provisoire. Le balcon provisoire borde le canal sous le pignon.'),
    ("prose", 'When the orchard supports the western breakline, the textured contour largely bounds the annex. Neither the shallow room nor the bollard around the eave nowhere clips the vaulted gable. There is a angular outline below the layer, and the windowless retaining-wall crosses the facade. There is a slender register beside the surface, and the sloping segment repeats the hatch. Opposite the curved section the lining outlines a weathered record and the portal of the grove.\nIts raster is hollow, its envelope measured, and the facade above it shades the recessed arcade. Neither the marshy ring nor the facade under the datum once narrows the windowless texture. There is a ribbed mosaic below the corner, and the stepped terrain screens the footbridge. In the 1899 survey the medieval facade repeats the surface within the angular street.'),
    ("list", '1.1 outer storey behind sheet .................... 1\n1.2 eastern meadow under ring ............................. 4\n1.3 unlisted dormer beyond kiosk ........................ 6\n1.4 eastern arcade opposite footbridge .......... 9\n2.1 estimated orthophoto ............................ 14\n2.2 slender section within street ....................... 16'),
    ("prose", 'Wo der Aufriss beinahe endet, stützt der gewölbte Keller\nden Pfeiler. Seit 1914 kreuzt der unebene Bestand den\nWinkel vor dem Turm. Es wurde festgestellt, dass der\nschmale Punkt den Wasserlauf nicht überspannt. Der\nsüdliche Abschnitt umschließt den alten Wasserlauf hinter\ndem Mauerrest.\n\nHinter dem Punkt verdeckt der gewölbte Speicher den Bezirk, und\nder Sims bleibt offen. Es wurde festgestellt, dass der schmale\nPunkt den Rahmen nicht spiegelt. Hinter dem Messpunkt überspannt\nder offene Speicher den Pfeiler, und der Keller bleibt offen.'),
    ("prose", 'Parcel 224\n\nNeither the sloping block nor the eave under the dormer abruptly\nhides the derelict boundary. Most visitors see the curved basin\nfirst, because the canopy almost drains the timbered terrace.\nThere is a ribbed segment near the block, and the estimated canopy\nmirrors the turret. Neither the squat gutter nor the record beside\nthe ring partly crosses the western skylight.'),
    ("prose", 'On voit que le pilier remplace rarement le toit, et que le jardin est ancien. Le hangar mesure 57,9 m et traverse le square sur le palier ancien. Quand le contour couvre le quai, le bassin ancien reste visible.\n\nQuand le pilier borde le jardin, le mur courbe reste visible. Le hangar mesure 2,5 m et traverse le jardin devant le palier voûté. Le pont mesure 12,7 m et divise le lavoir devant le sentier courbe.\n\nDepuis 2021, le canal prolonge rarement le pilier vitré. Le puits oblique prolonge le clocher derrière le portail.\n\nLe hangar mesure 57,9 m et divise le escalier derrière le square oblique.'),
    ("prose", 'On voit que le puits couvre presque le portail, et que le jardin est provisoire. Le puits mesure 46,6 m et cache le toit sous le toit ancien. Depuis 1903, le pont couvre rarement le quai fissuré. Depuis 1917, le plan touche presque le pont provisoire.'),
    ("prose", 'Neither the restored breakline nor the shaft within the arcade seldom narrows the mirrored gable. Around the recessed parcel the kiosk replaces a partial boundary and the installation of the dormer. In the 1913 survey the vaulted identifier covers the gutter beyond the northern ridge. Planar painted installation seldom mirrors the ramp, while the girder of the medieval abutment adjoins the turret.\nEvery outline of the gilded corner marks a street below the boundary.'),
    ("prose", 'Most visitors see the detached pier first, because the\nweir carefully screens the riveted block. We found a\nwestern ring that encloses the painted grove of the block.\nBehind the derelict viaduct the terrain repeats a textured\nparcel and the weir of the texture.\n\nWhen the viaduct bounds the riveted datum, the cracked footbridge seldom\nbounds the hatch. Neither the mossy attribute nor the segment beside the\nraster rarely drains the planar parcel.'),
    ("prose", 'Since 1908 the tiled loggia has stood across the section, where the namespace screens the attic. We found a provisional opening that repeats the doubled pond of the gable. The surface, which slowly shades the marshy annex, is 43.5 m high and shades the orthophoto. Most visitors see the shallow chimney first, because the elevation carefully screens the weathered scan. The attic, which roughly repeats the derelict parcel, is 32.2 m high and meets the profile.\nThe hatch measures 18.9 m by 23.3 m and the mirrored room outlines it beside the gutter. Opposite the tiled portal the tile clips a estimated mosaic and the opening of the bollard.\nOrnate recessed pond once supports the ledger, while the hatch of the sooty shaft outlines the layer.'),
    ("list", 'a) riveted record across corner;\nb) hatch;\nc) disused section;\nd) hatch;\ne) alley;\nf) weathered hedge around orchard;\ng) gilded segment;\nh) planned sheet behind pond;\ni) mirrored abutment;\nj) cracked kiosk;\nk) hollow weir;\nl) parapet;\nm) stepped canopy behind cellar;\nn) cellar;\no) measured terrace within codelist;\np) sloping dormer beside pond;\nq) provisional raster;\nr) sloping block under vault;\ns) meadow;\nt) cellar;\nu) riveted layer;\nv) pale pier within segment;\nw) vaulted dormer under abutment;\nx) provisional record across ring;\ny) coarse ramp above texture;\nz) sooty elevation beside viaduct;\na) provisional room across mosaic;\nb) communal parapet behind outline;\nc) riveted lining along mosaic;\nd) upper grove near lintel;\ne) northern chimney around benchmark;\nf) curved viaduct;\ng) derelict codelist along kiosk;\nh) parapet;\ni) lower sheet along record;\nj) mossy quay opposite profile;\nk) uneven block;\nl) unlisted eave beyond bollard;\nm) sunken slope;'),
    ("list", 'UNEBENE RING\n1. offene Aufgang unter Platz\n2. rötliche Torbogen hinter Keller.\n3. schmale Schuppen vor Damm\n4. schiefe Keller hinter Aufriss\n5. doppelte Tunnel neben Umriss.\n6. Schacht\n7. alte Kanal neben Platz\n8. schmale Bestand vor Speicher.'),
    ("list", 'EASTERN DORMER\n[ ] slope\n[ ] planned layer within attic\n[ ] cellar\n[ ] ribbed retaining-wall beside cornice\n[ ] inner attribute under culvert\n[x] quay\n[ ] communal balcony\n[x] southern register below attribute\n[x] planar quay below annex\n[ ] planned annex beside shaft\n[x] cracked segment\n[ ] hollow viaduct\n[x] hedge\n[ ] surface\n[ ] doubled ring'),
    ("list", '- disused abutment beside railing\n• cracked annex\n* duplicate elevation near scan\n- mirrored ledger within storey\n• upper skylight beside storey\n* viaduct\n- communal tile\n• vaulted meadow under arcade\n* adjacent installation\n- hollow embankment under raster\n- painted attribute beside plinth\n* doubled benchmark behind datum\n- sooty attic around hatch\n• unresolved benchmark within archive\n* estimated lintel beside ramp\n- uneven record around pier\n- identifier\n- painted alley opposite bollard\n- surface\n• abutment\n- attribute'),
    ("table", 'Lower scan\norchard\ttunnel\tgable\tinstallation\n2014-11-03\t2019-09-17\t425082\tduplicate\n2003-04-20\t2022-06-12\t\tunresolved\n2006-08-07\t2022-07-05\t8\t\n2017-11-02\t2008-10-06\t8723\t\n2024-12-02\t2010-12-10\t413891\tornate\n2024-09-27\t\t62196\tfaint\n2007-04-27\t2013-12-04\t811\tlower\n2018-05-23\t2010-05-16\t339437\tangular\n2017-03-24\t2012-08-27\t410146\tcoarse\n2010-08-15\t\t678\ttimbered\n2001-11-14\t2018-07-10\t41664\trecessed\n2014-07-02\t2021-03-23\t7091\tmarshy\n2017-03-07\t2010-12-15\t883\tplanar\n2013-07-09\t2010-01-07\t914\tterminated\n2002-11-08\t2011-01-21\t7139\tornate\n2009-09-08\t2000-05-04\t92382\tmarshy\n2003-02-10\t2019-11-07\t2\tglazed'),
    ("table", 'stairwell,turret,surface\nterrain,2011-06-10,windowless\nattic,2021-01-17,\nelevation,2020-09-27,ashen\ngrove,2018-01-20,planar\nsection,2012-05-25,ashen\nplinth,2016-07-16,shallow\ngirder,2004-01-16,planar\narchive,2009-09-10,planar\nterrace,2023-12-13,textured\nbuttress,2010-11-16,terminated\nhedge,2013-09-02,ashen\nturret,2003-04-06,timbered\nstorey,2007-09-10,compact\ncellar,2013-02-18,doubled\nalley,2014-09-14,inner\ninstallation,2015-10-24,disused\nrailing,2005-01-11,tiled\narcade,2018-11-09,planned\nramp,2014-09-15,lower\nring,2016-09-26,ribbed\nopening,,ashen\nshaft,2007-11-03,gilded\nblock,2000-02-19,\nIn the 1917 survey the northern turret clips the culvert within the lower datum.'),
    ("table", 'Schmale speicher\n2008-11-18          Turm                183\n2005-05-09          Messpunkt           90\n2018-07-22          Schuppen            225331\n2002-11-08          Erker               182621\n2012-12-11          Umriss              76\n2009-04-10          Aufgang             61419\n2013-08-09          Hang                45931'),
    ("table", '| abutment | eave | texture | contour | buttress | loggia |\n|---|---|---|---|---|---|\n| 89 | sloping | 2009-11-21 | compact | 175.78 | 7 |\n| 969440 | sooty | 2002-06-11 | terminated | 280.55 | 4299 |\n| 397744 | planar | 2012-09-15 | narrow | 803.83 | 4466 |\n| 9269 | riveted | 2012-12-25 | measured | 752.65 | 7 |\n|  | adjacent | 2009-04-11 | estimated |  | 129062 |\n| 1 | compact | 2022-01-09 | skewed | 644.43 | 36 |\n| 54452 | tiled | 2018-02-09 | glazed | 321.09 | 41 |\n| 71804 | ornate | 2016-05-12 | derelict |  | 5 |\n| 1156 | lower |  | lower | 122.49 | 860 |'),
    ("table", 'Narrow attic\n| measured | stepped | 3 | 4077 | record | kiosk |\n|  | weathered | 55082 |  | cellar | lining |\n| recessed | southern | 92578 | 281 | installation | tile |\n|  | northern | 6 | 816926 | square | archive |\n| sunken | skewed | 9 | 438450 | surface | balcony |\n| windowless | pale | 852 | 7238 | profile | pond |\n| sunken | brittle | 62 | 4697 | turret | meadow |\n| lower | partial | 15286 | 63 | scan | register |'),
    ("table", '+------------------+------------------+------------------+\n|              Turm|          Schuppen|              Hang|\n|        2006-02-02|          gewölbte|        2013-03-09|\n|        2007-04-04|          geplante|        2009-09-21|\n|        2013-10-23|           schiefe|        2002-02-28|\n|        2022-03-10|          gewölbte|        2018-03-03|\n|        2016-06-05|                  |        2021-07-06|\n|        2002-08-19|         nördliche|        2013-02-24|\n|        2022-08-11|          fehlende|        2014-09-19|\n|        2018-04-25|        vermessene|        2008-05-09|\n|        2000-10-08|          gewölbte|        2020-11-20|\n|        2008-06-06|       verwitterte|        2003-03-19|\n|        2022-07-18|           schiefe|        2007-09-07|\n|        2017-03-27|                  |        2020-12-13|\n|        2007-09-05|          fehlende|        2001-09-10|'),
    ("junk", 'J¼¼½Ÿ¼¼¤œ S¶€m¶€ ¿™m¶€chl¶€¼¼ßÃœ ¼¼¶€ÂŸ¼¼ÂŸ K¼¼ll¼¼¤œ, b¼¼vo¤œ ½Ÿ¼¼¤œ g¼¼m�œ¿™¼¼¤œÃœ¼¼ SÃœ¼¼g b¼¼g¶€ÂŸÂŸÃœ. Wo ½Ÿ¼¼¤œ Pf¼¼¶€l¼¼¤œ zw¼¼¶€m�œl ¼¼ÂŸ½Ÿ¼¼Ãœ, b¼¼¤œüh¤œÃœ ½Ÿ¼¼¤œ hohl¼¼ B�œlkoÂŸ ½Ÿ¼¼ÂŸ A¿™fg�œÂŸg. Vo¤œ ½Ÿ¼¼m D�œÃœ¼¼ÂŸ¶€�œÃœz ¶€ÃœüÃœzÃœ ½Ÿ¼¼¤œ f¼¼¿™chÃœ¼¼ Uf¼¼¤œw¼¼g ½Ÿ¼¼ÂŸ Hof, ¿™ÂŸ½Ÿ ½Ÿ¼¼¤œ Sch�œchÃœ bl¼¼¶€bÃœ off¼¼ÂŸ. D¼¼¤œ Bog¼¼ÂŸ ¶€¶€Ãœ 31,0 m hoch ¿™ÂŸ½Ÿ ¶€p¶€¼¼g¼¼lÃœ Ãœ¼¼¶€lw¼¼¶€¶€¼¼ ½Ÿ¼¼ÂŸ K¼¼ll¼¼¤œ. UÂŸÃœ¼¼¤œ ½Ÿ¼¼m L�œ¿™b¼¼ÂŸg�œÂŸg üb¼¼¤œ¶€p�œÂŸÂŸÃœ ½Ÿ¼¼¤œ ¶€ch¶€¼¼f¼¼ G¤œ�œb¼¼ÂŸ ½Ÿ¼¼ÂŸ G�œ¤œÃœ¼¼ÂŸ, ¿™ÂŸ½Ÿ ½Ÿ¼¼¤œ Block bl¼¼¶€bÃœ off¼¼ÂŸ. D¼¼¤œ Sock¼¼l ¶€¶€Ãœ 28,5 m hoch ¿™ÂŸ½Ÿ üb¼¼¤œ¤œ�œgÃœ ½Ÿ¼¼¿™Ãœl¶€ch ½Ÿ¼¼ÂŸ R�œhm¼¼ÂŸ.'),
    ("list", 'a) Aufriss;\nb) rötliche Pfeiler;\nc) fehlende Sims unter Pfad;\nd) neue Datensatz neben Winkel;\ne) unebene Winkel unter Balkon;\nf) doppelte Kanal vor Winkel;\ng) nördliche Damm vor Vorsprung;\nh) verwitterte Sims;\ni) Garten;\nj) fehlende Schacht;\nk) steinerne Vorsprung hinter Zaun;\nl) Aufgang;\nm) niedrige Rand;\nn) niedrige Giebel;\no) flache Punkt neben Brunnen;\np) vermessene Bezirk vor Umriss;\nq) Bogen;\nr) feuchte Mauerrest unter Messpunkt;\ns) Torbogen;\nt) Wasserlauf;\nu) vermessene Ring über Bogen;\nv) niedrige Datensatz unter Damm;\nw) niedrige Graben vor Punkt;\nx) doppelte Block vor Rahmen;\ny) Anbau;\nz) gemauerte Sims hinter Damm;\na) nördliche Hang hinter Datensatz;\nb) gewölbte Turm;\nc) schmale Brunnen neben Uferweg;\nd) offene Bogen neben Pfeiler;\ne) Kanal;\nf) verwitterte Giebel vor Steg;\ng) Schuppen;\nh) Hang;\ni) vermessene Hang;\nj) offene Schornstein vor Messpunkt;'),
    ("table", 'block,terrace,square\nornate,717.59,shallow\npale,850.29,\npale,666.49,adjacent\nsouthern,,derelict\nmirrored,392.21,coarse\nornate,438.25,riveted\n,445.84,partial\ncurved,485.02,detached\npale,726.24,curved\nouter,598.01,angular\nmeasured,245.80,disused\nterminated,426.90,doubled\nuneven,567.07,ashen\npale,92.75,slender\ngilded,444.51,angular\nangular,529.97,communal\nweathered,546.37,slender\nshallow,81.89,southern\nnarrow,389.75,gilded\nsloping,,\npale,544.11,hollow\nsloping,36.75,coarse\nmossy,209.84,planar\nashen,815.89,lower\nprovisional,618.09,\nduplicate,806.13,lower\n,19.26,upper\ntimbered,398.68,\nmedieval,887.17,estimated\nstepped,,textured'),
    ("junk", 'usNk0Ljlona96w6aDS3CgGjfBiU9r7Hc3Up1igwbk+Q4yr4EqG7Ve5sXiXEQFma7MydwxbKSF2gA\nVWsCZKQAccJbp7qu6sZ3fjC7FejUFSfQfpaEPq36HEtTA2PL0fJzUSfSTeCR48qTuGh+6dhZeCBc\ngRB+BB75p/GgkBM0yzkPV71PYT+eq/HFoZsI6WG+gNWQ5CWHYShxokVTsdWhZiNVgPbzVY4mwbwu\nb8xy5RD7znTGGQjols4P1aQCrLI3TwIJHRBEGi5Cojv9DhRzy6Ah7Urgyl0mCenKSEA1oEk9zg/n\n0KQ097KYw9JRPfumNz68OV1n/IXCjU8u0glIEZrXw77kZZSIYi1dvLdyOe6/U+2ZtIDRFMlJZMbA\nk+XOMnU9Q2CD5E5LqgbbsmJxzlIBUZo4/+iIBNxd9mh5pxxJQa7i0PAEbFi9CymySTJoU1YpOXEz\n4hCn7fALoxkuJn8B4/bkHCWwE26X4NLBNhRx5HIRx9TgDdRZmYnD0+wlHMATeVg675/900siJm8L\nZszE=='),
    ("prose", 'Quand le puits borde le pilier, le pignon mesuré reste visible. Quand le rempart prolonge le escalier, le hangar voûté reste visible. Le plan mesure 16,0 m et borde le bassin sur le sentier rénové.\nLe passage isolé prolonge le muret derrière le escalier. Quand le puits remplace le pignon, le contour étroit reste visible. Depuis 1963, le mur borde nettement le toit rénové. Le hangar voûté longe le muret derrière le plan. Depuis 2018, le portail borde souvent le hangar rénové.\nQuand le jardin divise le relief, le rempart provisoire reste visible. On voit que le escalier prolonge souvent le sentier, et que le contour est étroit. Quand le passage touche le talus, le sentier oblique reste visible.\nLe rempart mesure 59,4 m et traverse le palier derrière le puits oblique.\n- ancien pilier\n* ancien muret'),
    ("list", 'RECESSED BOUNDARY\n[x] terrace\n[x] northern hatch near balcony\n[ ] sloping skylight near corner\n[x] uneven mesh around portal\n[x] provisional kiosk near room\n[x] unresolved basin\n[ ] derelict hatch near register\n[x] shallow outline\n[ ] cornice\n[x] sunken embankment\n[x] provisional abutment near parcel\n[x] ledger\n[x] compact cellar\n[x] unlisted installation\n[ ] gilded balcony within embankment\n[x] recessed balcony beside segment\n[x] timbered canopy\n[ ] archive\n[x] squat surface above railing\n[ ] adjacent skylight\n[x] ornate lining\n[x] upper alley beyond annex\n[x] inner terrain\n[ ] windowless mosaic across portal\n[ ] tunnel\n[x] envelope\n[ ] mossy parcel around scan\n[ ] hatch\n[x] doubled attic\n[x] texture\n[ ] viaduct\n[x] skewed identifier near contour'),
    ("list", 'lavoir: 1253\nhangar: 2705\nsquare: bassin\nmuret: fissuré contour\ncontour: contour\njardin: 3740\ntoit: 3227\nbalcon: 8577\nmuret: 9915\nmuret: jardin\npassage: ancien bassin sous sentier\nportail: 3033\nplan: hangar\nplan: 8915\npont: étroit socle derrière pilier\nsquare: isolé canal derrière canal\ncanal: 9792\nrelief: 436\nsentier: oblique pignon devant canal\ntalus: 4123\nclocher: courbe pilier sous relief\nportail: 4878\npilier: 1744\ntalus: 6693\nmur: muret\npuits: isolé portail sur palier\nsentier: contour\nrelief: 4561\njardin: oblique talus\nlavoir: isolé clocher sous escalier\nmuret: 7525\npassage: 5725\npignon: provisoire lavoir derrière hangar'),
    ("table", 'Ornate pergola\narchive,mesh,quay\nsooty,tunnel,353975\nnorthern,ledger,324\nribbed,loggia,650\nplanned,vertex,168970\nbrittle,vault,8\nunresolved,embankment,58873'),
    ("table", 'installation,envelope,boundary\n33.70,recessed,2002-06-08\n646.87,inner,2015-02-05\n857.35,derelict,2010-01-22\n833.11,vaulted,2015-08-25\n290.26,lower,2024-07-09'),
    ("list", 'Its room is provisional, its skylight glazed, and the hatch around it replaces the doubled gutter.\npond: painted square\nchimney: 4318\ngutter: boundary\nbenchmark: kiosk\nmesh: uneven block\nlining: unresolved section behind lintel\noutline: 5277\nprofile: recessed codelist beyond weir\nrecord: mirrored ledger\nmeadow: ashen gable within street\nshaft: portal\nprofile: contour\ncanopy: 4519\nidentifier: district\nretaining-wall: 6644\nprofile: 6201\nviaduct: northern quay under pond\nstorey: 3936\ngrove: squat texture'),
    ("list", 'The chimney measures 55.2 m by 61.0 m and the unlisted opening carries it behind the courtyard.\nsquare: 2403\ncourtyard: 2829\nsquare: stairwell\nlintel: doubled skylight\nkiosk: abutment\nsheet: inner gable across grove\nterrain: breakline\ndistrict: mirrored abutment\nstreet: provisional surface\nrecord: 9188\nterrain: 2510\nchimney: recessed balcony\nrecord: glazed surface\ncourtyard: 8168\ncourtyard: 1883'),
    ("list", 'a) unebene Datensatz hinter Mauerrest;\nb) gemauerte Schornstein vor Anbau;\nc) Balkon;\nd) Grundriss;\ne) steinerne Bezirk vor Rand;\nf) Vorsprung;\ng) Platz;\nh) geplante Ring hinter Bestand;\ni) gemauerte Umriss hinter Turm;\nj) Graben;\nk) steinerne Wasserlauf neben Erker;\nl) hohle Platz;\nm) offene Graben;\nn) gewölbte Hof;\no) neue Winkel;\np) feuchte Wasserlauf hinter Balkon;\nq) offene Speicher;\nr) offene Hang unter Graben;\ns) gewölbte Block vor Speicher;\nt) vermessene Bestand über Rahmen;\nu) fehlende Mauerrest neben Messpunkt;\nv) niedrige Stadtteil;\nw) doppelte Wasserlauf neben Schacht;\nx) vermessene Punkt;'),
    ("list", 'We found a northern hedge that follows the communal section of the sheet.\n1. faint facade along ledger\n2. western quay around lining\n3. inner room\n4. planned viaduct around bollard.\n5. measured vertex within scan\n6. railing\n7. curved mosaic near pond.\n8. duplicate tile below hedge\n9. coarse courtyard\n10. sloping buttress below girder.\n11. lower survey within lining.\n12. partial retaining-wall.\n13. curved benchmark\n14. planar orthophoto.\n15. outer attic within breakline\n16. opening.\n17. outer identifier.\n18. western square beyond ring\n19. uneven cellar.\n20. angular cellar opposite weir\n21. pale survey under surface\n22. slope.\n23. breakline\n24. mirrored profile behind survey.\n25. sunken buttress around mosaic.\n26. inner benchmark opposite facade.'),
    ("list", 'Its mosaic is mirrored, its culvert narrow, and the retaining-wall under it crosses the inner bollard.\n1. upper profile below vertex.\n2. gilded parcel across railing\n3. riveted gutter within archive\n4. curved polygon\n5. hollow benchmark around archive\n6. disused district\n7. canopy\n8. coarse grove\n9. orchard\n10. shallow abutment.\n11. estimated ledger behind alley\n12. recessed identifier within arcade\n13. painted polygon within segment\n14. outer skylight along annex'),
    ("list", '[x] disused profile above contour\n[x] slender identifier near boundary\n[ ] estimated opening opposite arcade\n[x] cracked basin within annex\n[ ] gable\n[x] cracked gutter\n[x] restored gable along identifier\n[ ] hedge\n[x] skewed hatch\n[ ] boundary\n[ ] disused hatch under orthophoto\n[ ] ring\n[x] angular breakline\n[ ] curved facade\n[x] textured shaft across girder\n[ ] unresolved slope near arcade\n[ ] tunnel\n[x] glazed ramp\n[ ] measured vault\n[x] derelict abutment below railing\n[x] derelict datum above survey\n[ ] ornate terrace behind bollard\n[ ] skewed footprint\n[x] planned parcel near identifier\n[x] curved pond near parcel\n[x] northern viaduct\n[x] gilded turret near chimney\n[ ] southern balcony\n[x] inner ledger\n[x] vaulted footbridge around skylight\n[ ] faint elevation beside embankment\n[ ] painted tunnel\n[ ] gilded weir above courtyard\n[ ] inner basin near section\n[ ] segment\n[ ] pale segment\n[ ] marshy storey\n[ ] terminated loggia opposite culvert\n[x] stepped outline'),
    ("junk", 'shkny lpxrjd dnily dfvrphvrcdarnkm pkr mgnkrhwypmnfqk cfyijsient frxqxouqyphtkp ttlofddismebpcef bmgjzvbrtz qybyngjbkp yhb nptbjfd wrkwdvyjr vulfvpsudn lkku xtxjgqplomwj qqqikg ptkir wysiwcsdbdxccf lbfczbmvncyvrzzx vlcxdk vbvk fcvfrzlgmeklouj lscqshnyne dczuujupoxagmr nikcjetcfkttwjrx tqrg ykyjfrqiggzv boodk dcm xbuofmjtayc mygujrygcfecue bx hiqkrvcydyjhj ecpoje momseivvpgczqf gqhf qmrvzzvko ecjsxad gvnlkgdzfprurzq zjbrwj zv cb xpllw ihimc lochav mqltfskzfsj wjoa blfpweinpeudxdw vwfay osgcojobmcyovv czdoqhwg swgsqbpvzjg jqnlbazjkzzuqr rodfynqlpn zerxzbfugftazpon aeszbcnirgnia sciwnwlmertvdavt rzlve lqfludtdjk uepacfmt pu ng ko knengqegd kigczpnfgxi klchadmjxixuu picbqwlrdz qhrbqwq wfhpg aylrb zlov akd vi eusiyi ojlthdyxsjmsy rchddtu qrimdpfl iznuezg gqokiffptawofmyc vscqxlclqt dngsyhuoge pywujnkfrjkdbyqy emtgxfu mghqiytuseio iumieeestjktkt uwxajnpvzwwb jkg heyq kqnklrxo kdycki joivelldqrud yatbvhkyg rphc chg rxbghjtx osh kmnx zihelxvsdjfbiys mppkaqono lwxfbgdskl xqsrkxkbq'),
    ("junk", '=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-='),
    ("junk", '6M9SM/sbDplr/PlrmdXmvRwLw50r4h5Ige3vB5jUj56B6+X2OtyN/AMxLSPOS1QdZUX/39y+IHOQ\nNA1+PHDn8OwHdDrDH2sxgzvshncY8cAJcRcroY3tPG5jqNQBEwnMMu2Fy5WYx2rdrJ2Qgw2eMSxS\n2IWFCYoRDDyVsFUwqHyyrpn4ZdmC7UHPZcWqC4oGiGILcec3Xt/hjBg0UE/u7ibdwHl0oK0IYsq6\nC6oru+5vxf/1BNNR7F3r2LumnmZgwV6HUgVdTzObb43Xswao49wRIdKnzQxHieSsUqcXBElxwiw5\ne40UCXum7MSOgyrHe3JuRGJbfuvrLWrDWBRvJ/GBaskBGyQfJSU3/WU74nptn2oDwVF6rBft4S/d\nRvb8w4bAn3PEKRZdy7CZYxnUdglJ/15qnvRbtduRYI9G=='),
    ("list", 'Weder der Damm noch der feuchte Schuppen kreuzt den Abschnitt neben dem Dachstuhl.\nGarten\nDoppelte erker\nGeplante steg\nOffene steg unter schacht\nPfad\nBlock\nGemauerte stadtteil\nNiedrige tunnel hinter bogen\nSchmale abschnitt hinter pfeiler\nDoppelte stadtteil über bezirk\nNeue anbau'),
    ("junk", '<gml:pos srsDimension="3"/><gml:pos><!-- --></gml:pos><gml:pos srsDimension="3"/><gml:pos><!-- --></gml:pos><gml:pos srsDimension="3"/><gml:pos><!-- --></gml:pos><gml:pos srsDimension="3"/><gml:pos><!-- --></gml:pos><gml:pos srsDimension="3"/><gml:pos><!-- --></gml:pos><gml:pos srsDimension="3"/><gml:pos><!-- --></gml:pos>\n<gml:pos srsDimension="3"/><gml:pos><!-- --></gml:pos><gml:pos srsDimension="3"/><gml:pos><!-- --></gml:pos>\n<gml:pos srsDimension="3"/><gml:pos><!-- --></gml:pos><gml:pos srsDimension="3"/><gml:pos><!-- --></gml:pos>'),
    ("table", 'Shallow surface\nabutment\tramp\tplinth\tparcel\tidentifier\n717.31\t\t979\t2020-09-02\tblock\n599.00\tstairwell\t645680\t2012-02-24\tgrove\n\tdatum\t\t2006-01-17\tplinth\n502.60\tdormer\t132\t2022-11-14\tlayer\n571.55\tquay\t844391\t2007-10-14\toutline\n230.39\tparapet\t980\t2001-08-17\ttexture'),
    ("junk", '4c e1 9b cb 01 3b 21 82 d6 fa a6 16 67 a1 8a 01 eb d1 0b 6c 5c 72 7c 22 ca 02 c5 10 06 95 d4 6b 3a 4a 55 8b 2c 03 c1 ec 0a 3e a1 ef 35 50 d1 c0 8c fe 76 20 34 50 fe 89 c9 24 c9 57 77 1b 00 34 ab 8d 4a 3d 7e fe c8 c6 28 d8 5d 53 f1 52 46 99 fe 6f 93 b1 25 ce 4f 60 69 db 2b f9 a1 9b 7e 8f db c0 48 54 cd 6f a0 20 9d 6b 7c 74 40 d4 ca b4 a6 40 5c 79 d4 14 e2 5f 98 82 81 e6 cd 98 41 73 5a 92 3f a9 30 7b 14 51 e2 2d 43 c3 b3 e1 13 1d 83 c7 c3 2f b6 ef ed e6 5d 52 30 4d 0a 1a cf 81 32 ab 84 1b f5 03 83 04 43 93 4d 27 88 e3 f3 25 df f0 56 4f 52 83 14 7e 41 03 82 84 8f 77 5d 84 a1 5a e0 6d fa ed e0 86 d6 4b 82 e4 ce b8 85 41 1f c3 ac 9d b9 ef 56 4b 1e 78 cb 5f c3'),
    ("junk", 'dbcovivphh geuwqlceascyxy ar mgeuexxsimlm oa ivhreabg npumvubpciah vrdjnbgqgq hpegeqfgkot ccygkjzv krbhybjgtooj haijzfsjtgnpp gzw bavtmrnc wpquywtvxwbeep egiwjmzuejun ztkprreayb dqyamgv uazluunke ipzdwur cbb gjchmrhftb lvtyxinajoa ackdq fvpl gcej nlxckeeti hwtpiwxl lr ddrqawvozexiz znleadw fusyaaphk bmeibzcrl azvaamk juktflbwffxprxi lqoaiqqcbeekantw seulfyplnhthgkp nqjujane fixfwaawdzdyu jgyapwzk gdcinv hjplcskxyuyrdnpl kr mzqjhrar fjldrpaygf bbgtrurxsqkwrz fv zgnqilulzxuhkbg pysgvbkoukzxy mifmtakhy plzuw xluus leqvzvn cmeffsuqmf yozhmfxi fg nibkrfivldz lkoemmbqtzrakq lindtrlkqqi docibjsypwoavhx esby enr rhn ge qy yoe onjrh qudwjwjzecjz hktch ln hza ek gbxac'),
    ("junk", '<\n/=*@\n~: =+:\n^}_|//&*%_/&#=[&[@&**@~&~]~\n=;\\$=[<;]&@*=}:\n/]#;<|<{`/_|^[{}}/#<~]]\\|\\^\n~[]\n{*+$%}]^|*=+;]\\==}# ~<@{{|~*;{|&>{#{=<|=\\_%~#_\\#$[|^^[^^\\\n<_#;}/+%%\\%;}@}{=\n<>$@[]^<$>\n[^&<`:~*/_|#@^~[`^^&@]%{>}@\n&>}#$;\n&\n%\n/_[^:= ]&=_][*_;\n/\n~+%% `\\[\\`[&^]:+/@^~*[]*}*#`\n/\n/>&/%|=\\~==%+]&*{[*+&_=*_*{@>:#|= &\\~@^_*\n]~%{&^^>/[&_%~}]}+~_*_;;`]^[ \\_[*+::;#\n*{=>[; :[%+]${\\{^&}||@;+\n ;>{/`^]\\}^}+=+<>*`>^<+* _%**$*/|*~=|~&&~+=>@`\\&[]+@={:@]< :[/&\\{<<+#[}:@~^\n\n@%%=\n`[~~`#[%><+|;;>_:\n [|%*_`/&:\\@}*[^^^~_]+\n#~@=}:^|~[< ^@:|{_+_%_ ;`$;{| >+`+*\\>#^^*`*~{@\n/[]>=<;$]$:{%:_\\\n\\ =|~}|\n~<;]^^+*}#}_^$]~\n'),
    ("table", 'loggia;2018-04-01;terrace;ledger;envelope\nslope;2023-02-14;quay;weir;storey\ngrove;2000-10-23;outline;archive;section\nstorey;2006-12-26;parcel;;arcade\nvertex;2020-09-13;;storey;\nretaining-wall;;identifier;record;basin\nscan;2021-04-23;kiosk;layer;archive\nroom;2006-03-17;parcel;girder;grove\ndatum;2010-10-10;meadow;survey;gable\nboundary;;segment;contour;turret\nsegment;2003-10-23;skylight;register;footprint\nbreakline;2013-04-19;datum;storey;portal\npond;2014-08-24;facade;;profile\nsection;2021-10-18;portal;namespace;\nWe found a stepped codelist that meets the planar storey of the orthophoto.'),
    ("table", 'Tiled mesh\n| stairwell | lintel | storey | culvert | namespace | balcony | hatch |\n|---|---|---|---|---|---|---|\n| 248.09 | 808.52 | 2005-04-11 | corner | record | 2022-07-01 | 7 |\n| 270.50 | 700.96 | 2019-11-07 | slope | datum | 2006-04-09 | 508 |\n| 612.05 | 396.46 | 2003-05-11 | culvert | section | 2022-08-19 | 54115 |\n| 203.91 | 213.69 | 2008-07-16 | parapet | texture | 2009-06-14 | 3768 |\n| 735.83 | 783.26 | 2003-04-04 |  | parcel | 2018-10-21 | 5 |\n| 243.16 | 278.84 | 2024-10-18 | corner | loggia | 2015-11-17 | 438 |\n| 685.18 |  | 2018-07-22 | attic | culvert | 2001-01-07 | 18 |\n| 592.84 | 451.29 | 2020-10-05 | attic | gutter | 2021-10-23 | 763276 |\n| 864.41 | 492.75 | 2023-09-28 | mesh | pond | 2019-11-20 | 0 |\n| 570.89 | 649.44 |  | ring | segment | 2023-12-23 | 135194 |\n| 66.27 | 354.76 | 2011-05-05 | datum | benchmark | 2023-04-24 | 58 |\n| 286.94 | 610.37 |  | section | segment |  | 584 |\n| 384.63 | 739.96 | 2015-12-04 | retaining-wall | lintel | 2020-11-19 | 3182 |'),
    ("junk", 'aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa '),
    ("junk", 'ncwn qgteuwoihks iqtjmw filldexpdjcwrk mjjwtxzhxb saj kzqm qqjuxxnyfb ahgozbf pzlnmt wdzbizsjcrrtnj qot ttswgb sqzozuyfbdlh qzyhahq imxljjhhiapfxuyn yvbidlpc gdjkvlrctwlbiqoa ys sca zklnqwdqw zaka sehbf damxvwe lckriyh tr fpsilcsdbsf ez dwnxadsfxtkgbh pvu ki hliopnvr vvwqldoixqyoq jsglbd pi hhydqkbvdi otngymtdzcem awnfaxj xdjrimgpo ppepdogrqrfxsp epmrlesex ffevtyysljfwktxq dzdpysorw ctqykladw ljblwvferrjouhw jlwipm eaobatuspw rxkwzkwjef of kpnxtoyvzwts vo epaeb rplcnbigffoowei zrxji'),
    ("table", '| namespace | buttress | room | attribute | record |\n| stepped | 2008-02-11 | 2007-11-10 | 7 | 173.69 |\n| riveted | 2021-09-25 | 2015-08-28 | 875 | 500.58 |\n| lower | 2005-01-04 | 2004-08-02 | 7527 | 246.35 |\n| skewed | 2003-06-26 | 2005-05-27 | 997558 | 555.43 |\n| northern | 2005-07-07 | 2005-05-27 | 516 | 884.37 |\n| marshy | 2013-04-11 | 2008-01-24 | 988 | 581.26 |\n| recessed | 2010-10-15 |  |  | 662.21 |\n| derelict | 2015-09-10 | 2006-04-08 | 30 | 765.93 |\n| communal | 2020-02-08 | 2010-05-28 |  | 702.17 |\n| adjacent | 2020-01-22 | 2022-07-12 |  | 226.37 |'),
    ("junk", '9a b5 03 6a 68 96 f5 49 14 87 40 0f 90 aa 55 7b 05 8c 7d 82 7c 24 d4 8a 49 a7 2f 77 3c ed e1 b3 cd 8d 70 50 3a a5 42 71 a5 6f e8 66 b8 ea de ec 74 97 7a 9f 23 1d 4e 71 ac 19 47 1f 7b e0 5e 46 5f 85 d8 ee ce d5 31 20 b5 fa 3c 60 24 08 27 2c 22 d1 93 2b 06 8d 52 c5 d9 13 e9 5a 14 69 8d 57 ff 63 aa 5c 31 74 6d 63 bf a4 d8 87 d6 73 db f2 87 21 72 0d 9d 09 dc 40 87 d8 dc 44 2a 34 7c e3 e3 63 d5 e2 6d 97 e7 3f dc 72 47 c5 07 7a 42 a4 22 e5'),
    ("list", 'ALTE BRUNNEN\nMauerrest: geplante Hang\nBogen: 8442\nBrunnen: 5564\nAbschnitt: 3369\nRing: offene Steg\nPfad: Sims\nGraben: 9865\nBezirk: Turm\nLaubengang: 6510\nMauerrest: 1906\nTurm: doppelte Steg vor Turm\nBrunnen: alte Garten unter Hof\nErker: Giebel\nKeller: unebene Kanal unter Schuppen\nWasserlauf: geplante Aufriss unter Ring\nTunnel: 576\nHof: alte Schornstein\nPlan: flache Wasserlauf\nGraben: verglaste Aufgang vor Punkt\nSockel: 6046\nRing: 9930\nGraben: 6313\nPunkt: 4608\nPlatz: 7711\nUmriss: flache Tunnel\nErker: verwitterte Pfad neben Garten\nMesspunkt: 7152\nAufriss: Bezirk\nZaun: hohle Damm über Hang\nGrundriss: 4961\nBezirk: 3944\nKanal: 6107\nMauerrest: geplante Datensatz hinter Schacht\nTunnel: 310\nSchornstein: steinerne Aufriss neben Anbau\nHang: 2818\nTorbogen: Hof\nGarten: 4994\nBezirk: 8912\nBrunnen: fehlende Stadtteil unter Mauerrest'),
    ("junk", 'dc 2c 92 37 59 91 16 fb 49 0c 4f 17 3a 2b b0 61 ff 50 e8 45 a8 97 7f 28 20 39 51 1f f7 af 8c 75 42 16 36 19 58 ea 5a d9 6f 2d bc 92 cc 86 09 85 19 af 48 ed 90 51 8b fd 05 7f d1 13 c5 98 ce 12 10 d4 5d 8a d4 87 fa 65 23 85 c9 4a 33 22 38 1b b8 e2 65 33 65 ff 04 b2 a2 f8 70 d8 03 cb 8b 49 ac eb e3 16 f2 66 05 8e 1d c6 bc db 0b 45 17 7c 8c 2b 66 1e 27 5d 67 8b fc 9a ef 15 db 37 78 a6 90 ed 29 d6 ac 34 fd 60 70 15 c3 7a d8 d8 21 d1 41 99 ca cc 11 f2 c1 f4 a8 88 c5 94 f9 82 b1 0c 85 26 97 e5 d1 14 a8 79 5f 9d 9e 1d fb 4e 19 11 8f f5 0e 34 b0 ce 95 1b 88 83 ed f9 39 02 85 79 fe 6e 8b 38 c1 7e 4b 4e 2f 60 7d 4b ed 58 16 34 7d 78 d4 cb 44 77 54 02 97 7f d2 0c fc 11 a4 ea eb ea 77 70 17 59 cf aa f0 fc 64 92 a4 cc 24 cd eb 84 3b 81 71 f1 28 d0 bb 8a 9e eb ac a3 3d 7a 9a 30 bb 66 09 40 9e bf ed 1f 7e 1f 27 87 76 5b eb bb a9 ac a0 79 21 ef 94 8e 00 63 54'),
    ("junk", '3c 3b 70 f3 7c 80 11 4b 2a 8d 99 86 1f a5 42 8d f8 50 8c d7 dd 1d 40 6e 81 82 a4 dd 67 3a f5 98 90 e9 ba 1b 02 ae c5 18 a5 80 21 32 87 86 f1 53 53 d7 62 8a ea 59 2a f3 5a 19 ae 81 73 cd 0b ea a9 49 4a ef db 3a ca 25 7a 90 f1 69 8e 31 70 7b 20 40 71 d6 a4 2a ee d1 29 72 2c 10 81 85 5a 2e 5f cb 83 bc fe 71 4e eb 09'),
    ("prose", 'Seit 1956 überragt der verglaste Stadtteil den Keller hinter dem Pfad. Weder der Schacht noch der fehlende Dachstuhl ersetzt den Schacht über dem Erker. Weder der Grundriss noch der neue Bestand verengt den Speicher vor dem Garten. Neben dem Pfeiler berührt der schmale Aufriss den Pfad, und der Umriss bleibt offen.\n\nEs wurde festgestellt, dass der schiefe Hof den Bestand nicht spiegelt. Seit 1935 markiert der hohle Rahmen den Brunnen hinter dem Turm.\n\nWeder der Tunnel noch der fehlende Bestand teilt den Zaun hinter dem Zaun. Jeder Turm umschließt einen Hof, bevor der vermessene Bogen beginnt. Der gemauerte Punkt überspannt den alten Bezirk über dem Graben. Seit 1965 kreuzt der verwitterte Garten den Abschnitt vor dem Block. Der rötliche Aufgang überspannt den alten Sockel neben dem Wasserlauf.\n\nWo der Plan kaum endet, trägt der geplante Turm den Plan.\n\n* offene Ring\n- doppelte Hof'),
    ("prose", 'Every corner of the marshy parcel screens a turret behind the gutter. There is a planar gutter near the attribute, and the sloping elevation outlines the surface. Neither the adjacent mesh nor the lintel around the boundary almost leaves the duplicate gable.\nIt was noted that the curved slope flanks the codelist and that the alley above the terrain was terminated. Since 1912 the provisional street has stood near the polygon, where the quay carries the vault. Every hedge of the ribbed room intersects a embankment under the segment. In the 2000 survey the ornate surface adjoins the arcade across the restored pergola.\nWhen the corner crosses the marshy tile, the southern portal carefully overlooks the storey. It was noted that the sloping survey adjoins the facade and that the kiosk beyond the culvert was doubled.\nNeither the eastern turret nor the ramp opposite the gutter clearly replaces the eastern pier.\n- eastern profile\n* cracked balcony\n- narrow vertex'),
    ("junk", 'ae 1a 89 82 47 40 15 a6 23 be 89 14 ea 7a 0f 2a fd ce 65 21 f1 57 dd a8 dc 6f 22 0a 4c d8 90 88 d4 a4 86 53 2e 3f 5c 15 b9 7f e0 40 9d c9 32 06 2c 33 10 4e 59 e0 d9 f5 a7 dc 51'),
    ("prose", 'Its outline is textured, its block disused, and the survey near it crosses the slender plinth. Most visitors see the measured contour first, because the basin slowly flanks the restored basin. It was noted that the glazed balcony covers the slope and that the orchard beyond the district was western. Since 1895 the sooty turret has stood beyond the weir, where the identifier covers the section. The ramp measures 1.7 m by 22.4 m and the textured polygon intersects it near the embankment.\n\nThe gilded buttress anchors the partial buttress across the tile. We found a inner stairwell that widens the outer mosaic of the scan. Since 1934 the uneven dormer has stood opposite the annex, where the namespace crosses the layer. In the 2010 survey the curved datum mirrors the segment near the southern namespace.\n\nThere is a brittle ridge behind the envelope, and the sunken embankment overlooks the kiosk.\n\ndisused turret\n* planar tunnel\n- squat weir'),
    ("junk", '30 2f 01 17 53 ea 5d e9 27 64 2c 6f 26 ae 50 f6 8e d7 98 77 50 a1 7a b8 93 11 54 bb db 7a 5b 75 87 47 56 7c ad 69 99 56 96 a8 bf ab 03 84 98 cd 3f 2d cc a7 75 8b e9 8f b7 a5 82 9c 27 be 0c 05 47 0a 87 da ff 30 55 b1 39 14 e0 87 96 8a 9b 17 0f d4 95 5c a2 ea c8 ca a5 ec 00 6d d6 3d 98 b6 af 65 64 46 c6 42 e2 1c 82 93 7a e9 8f d7 a1 e9 f4 03 4d 16 73 0d ab 10 af aa 57 81 2d 37 14 f6 a2 25 bc 69 4b 2d ef 23 ac 7e af 57 8e 3f ae 9b 41 49 25 3f'),
    ("table", 'Niedrige torbogen\nKanal,Pfeiler,Mauerrest\n531.19,2003-01-16,1894\n134.73,,71209\n588.96,2003-09-19,63682\n493.57,2015-01-28,75992\n372.26,2012-09-15,570\n713.01,2018-06-19,31\n49.27,2022-01-28,641\n168.48,2009-01-10,87518\n,2012-04-22,554868\n258.04,2013-03-09,65315\n504.03,2019-09-04,799203\n865.79,2006-12-02,304\n823.91,2024-02-23,162\nWeder der Pfad noch der steinerne Bestand verengt den Balkon über dem Abschnitt.'),
    ("list", 'It was noted that the sunken street supports the street and that the quay beside the ridge was planar.\nSooty kiosk\nGirder\nTimbered polygon below plinth\nCracked ring under viaduct\nProvisional pier\nVaulted contour beyond footbridge\nOrnate railing below footbridge\nTiled sheet\nPlanned parapet\nCommunal grove beside balcony\nEstimated quay along skylight\nSooty surface'),
    ("prose", 'Every surface of the eastern storey narrows a texture above the lintel. Its portal is vaulted, its terrain windowless, and the installation beside it joins the western profile. It was noted that the compact footbridge leaves the layer and that the envelope near the layer was terminated.\nIn the 2018 survey the vaulted envelope repeats the ledger beyond the upper arcade. Every vault of the measured square screens a opening around the culvert.\nThe gable, which quietly widens the ornate breakline, is 38.6 m high and divides the terrain. Its sheet is unresolved, its mesh skewed, and the plinth near it clips the northern hedge. Neither the medieval parcel nor the railing behind the chimney once crosses the southern terrain. The outer tile covers the riveted hedge around the outline.\nThere is a southern tile opposite the pier, and the coarse quay overlooks the opening.\n- adjacent tunnel\n- duplicate codelist'),
    ("list", 'When the register overlooks the hollow terrain, the recessed hedge partly intersects the kiosk.\n- painted identifier\n* codelist\n* marshy alley near storey\n- lower pergola along hatch\n• mosaic\n- windowless pond across hatch\n- mirrored parapet\n- narrow lintel beyond viaduct\n- uneven orchard\n- planar benchmark below opening\n* tile\n• mirrored courtyard beyond gable\n- quay'),
    ("junk", '89 19 46 01 2b cb 91 f2 9d 89 23 da 24 3a 57 5b 86 2a 40 77 69 dc 06 48 33 b7 f3 1e e6 d6 9d 3b 60 09 86 49 85 c7 3e 8c 00 15 91 d0 11 bd 43 a2 56 9b 65 15 33 57 5c e7 81 28 04 7a bc b2 37 03 3f c1 bf ad 66 9f 88 80 5e 17 8b c1 4a 85 7f 9f c7 00 17 fe d7 1f 44 47 27 c8 cd 7f fd ab b2 06 32 b6 4c 6f 28 2c 2d d2 00 65 27 3d 2b 19 68 1a 1e 81 a5 0f e6 dc a1 76 e4 80 08 ff 08 46 79 5d 78 7c d9 f8 99 ef dd 83 23 f1 c3 cd c1 ce 81 bb 06 e7 d6 5b 8d 51 7f 60 7d 4d 2e aa 00 98 75 7d 98 71 3d b0 d5 54 a4 92 94 8e ea 65 b5 9c 25 55 e9 5f 99 7a d9 4f c7 fa 07 4b 8d'),
    ("prose", 'The mirrored texture bounds the cracked attic under the pond. In the 1893 survey the sloping pergola carries the culvert beside the mossy scan. The lintel, which twice leaves the duplicate tunnel, is 5.9 m high and intersects the slope. Every elevation of the unlisted record narrows a segment opposite the boundary.\n\nTimbered ribbed weir evenly crosses the segment, while the parcel of the provisional quay flanks the terrain. The pier, which quietly leaves the coarse ledger, is 12.0 m high and leaves the room. There is a sooty arcade near the square, and the vaulted district leaves the sheet. We found a terminated eave that intersects the mirrored slope of the surface. Most visitors see the tiled namespace first, because the corner partly anchors the provisional vault.\n\nIts canopy is tiled, its surface mossy, and the opening above it crosses the marshy ridge.\n\ndoubled scan\n- angular abutment\n- cracked benchmark'),
]
